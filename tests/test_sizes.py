"""Integrations and draws are registered at the operators' own size."""

import inspect

import numpy as np

from fieldspark.jobs import queries as jobs
from fieldspark.jobs import verification
from fieldspark.operators import lim

SF = "/root/testdata/sf0.001"


def test_registered_sizes(spark, monkeypatch):
    model = jobs._model(spark, SF)
    seen, whole = [], lim.ensemble
    monkeypatch.setattr(jobs, "_model", lambda *_: model)

    def small(*a, **k):
        called = inspect.signature(whole).bind(*a, **k)
        called.apply_defaults()
        seen.append((called.arguments["members"], called.arguments["steps"]))
        return whole(*a[:2], np.zeros(2), members=2, steps=2)

    monkeypatch.setattr(lim, "ensemble", small)
    for f in (jobs.lim_noise, jobs.ens_1yr, jobs.ens_long, jobs.long_scalar):
        f(spark, SF)
    assert seen == [(100, 1440)] * 4
    for name, query, want in (("perfect_forecast", jobs.verif_perfect, 10_000), ("ensemble_report", jobs.verif_ens, 1000)):
        real, got = getattr(verification, name), []

        def report(*a, real=real, got=got, **k):
            called = inspect.signature(real).bind(*a, **k)
            called.apply_defaults()
            got.append(called.arguments["iterations"])
            raise StopIteration

        monkeypatch.setattr(verification, name, report)
        try:
            query(spark, SF)
        except StopIteration:
            pass
        assert got == [want]
