"""Columns with odd names and kinds pass through what returns documents."""
import public_tokenizers
from pyspark.sql import functions as F

from marlstone.llm import bpe, exact_dedup, kn_quality, mixing, simhash

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_odd_names(spark):
    texts = ["a b c d", "a  b c d", "other words here", None, "a b c d"]
    rows = spark.createDataFrame([(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    odd = rows.withColumn("tick`ed", F.lit(1)).withColumn("dot.ted", F.lit("x")).withColumn("a b", F.struct(F.lit(2).alias("in side"), F.lit("y").alias("q`z"))).withColumn("map", F.create_map(F.lit("k"), F.lit(1)))
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for out, n in ((exact_dedup.exact_dedup(odd), 3), (simhash.near_dedup(odd), None), (mixing.mix_documents(odd), None), (kn_quality.quality_filter(odd, labels), None)):
        assert out.columns == odd.columns
        found = out.collect()
        assert found and all(r["a b"]["q`z"] == "y" and r["tick`ed"] == 1 and r["dot.ted"] == "x" and r["map"] == {"k": 1} for r in found) and n in (None, len(found))
    encoded = bpe.encode(odd, RANKS, PATTERN).withColumn("a b", F.struct(F.lit(2).alias("in side"))).withColumn("tick`ed", F.lit(1))
    decoded = bpe.decode(encoded, RANKS, PATTERN).collect()
    assert len(decoded) == 5 and all(bytes(r["decoded"]).decode() == (texts[r["doc_id"]] or "") and r["a b"]["in side"] == 2 for r in decoded)
