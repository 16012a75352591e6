"""Language ID: the driver gives the memory of the fit back before anything else runs."""

from __future__ import annotations

from keelgrid.llm import langid


def test_memory_goes_back_after_the_fit(spark, monkeypatch):
    seen, real = [], langid.fit
    monkeypatch.setattr(langid, "fit", lambda *a, **k: (real(*a, **k), seen.append("fit"))[0])
    monkeypatch.setattr(langid, "give_back", lambda: seen.append("back"))
    df = spark.createDataFrame([(i, "der die das" if i % 2 else "the of and", "de" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    langid.identify(df)
    assert seen == ["fit", "back"]
