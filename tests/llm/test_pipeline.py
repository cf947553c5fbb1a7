"""The pipeline on a small folder of tables, against the operators' decisions taken one by one."""

from collections import Counter

import corpus_pipeline
from sedimenta.llm import decontam, mixing, neardup, pretokens, quality, rans
from tests.llm.test_operators import decoded, empty, near_rows, odd, prose, table


def test_pipeline_is_its_stages(spark, tmp_path):
    rows = near_rows() + [(5000, prose(77, 40) + "\n" + prose(1, 30)), (5001, prose(78, 60).upper().replace(" ", "!! ")), (5002, None), (5003, "")]
    docs = odd(spark).unionByName(table(spark, [(*r, "s" if r[0] % 2 else "t") for r in rows])).select("doc_id", "text", "lang", "source", "n_chars")
    bench = spark.createDataFrame([(1, prose(1, 30)), (2, prose(77, 40))], "item_id long, text string")
    labels = spark.createDataFrame([(k, int(k != 5001), 0) for k in [0, 100, 200, 300, 5001]] * 3, "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("benchmark", bench), ("labels", labels)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = quality.keep_good(docs, labels)
    one = neardup.keep_one(good)
    clean = decontam.drop_contaminated(one, bench)
    want = Counter()
    text = {}
    enc = pretokens.encoding()
    for r in mixing.mix_sources(clean).collect():
        text.setdefault(r.text, (*enc.encode_ordinary(r.text or ""), rans.END))
        want[r.doc_id, text[r.text]] += 1
    assert decoded(corpus_pipeline.run(spark, str(tmp_path))) == want
    ids = {i for i, _ in want}
    assert 5000 not in ids and 5001 not in ids and {5002, 4, 200, 300} <= ids


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    for name, schema in (("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd(spark), str(tmp_path))
        assert out.columns == odd(spark).columns and out.count() > 0
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty(spark), str(tmp_path)).count() == 0
