"""Encoded data and noise fall below the floors, also in part of a text and at its end; prose doesn't."""

import base64
import random

import pyarrow.parquet as pq

from studyloom.llm.quality_rules import quality_rules


def test_encoded_data_is_rejected_and_prose_kept(spark):
    rng = random.Random(3)
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text", "lang"]).to_pydict()
    found = [r.text for r in quality_rules(spark.createDataFrame([(x,) for x, lang in zip(table["text"], table["lang"], strict=True) if lang == "en"], "text string")).where("kept and length(text) > 1000").distinct().collect()]
    prose = "\n".join(sorted(found)).encode().decode("ascii", "ignore")

    def encoded(size):
        return base64.encodebytes(rng.randbytes(size)).decode()[:size]

    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(20)) for _ in range(60))
    texts = {
        "base64, 1500": encoded(1500),
        "base64, 6000": encoded(6000),
        "noise": noise,
        "three quarters": prose[:25_000] + "\n" + encoded(75_000),
        "end": prose[3 * 4096 : 6 * 4096] + "\n" + encoded(3000),
        "prose": prose[:25_000],
        "short prose": prose[:1500],
    }
    got = {r.name: r.verdict for r in quality_rules(spark.createDataFrame(list(texts.items()), "name string, text string")).collect()}
    assert got == {k: "kept" if "prose" in k else "chunks" if k == "end" else "incompressible" for k in texts}
