"""The operators' queries and their SQL."""

from __future__ import annotations

from terrafold.llm import bpe, decontaminate, langid, licences, neardup, quality, secrets, toxicity, urls, warc
from terrafold.llm.common import table


def op1_quality(spark, sf_dir):
    return quality.op1(table(spark, sf_dir, "documents"))


def op2_neardup(spark, sf_dir):
    return neardup.op2(table(spark, sf_dir, "documents"))


def op3_urls(spark, sf_dir):
    return urls.op3(spark, table(spark, sf_dir, "pages"))


def op4_warc(spark, sf_dir):
    return warc.op4(spark, table(spark, sf_dir, "pages"))


def op5_secrets(spark, sf_dir):
    return secrets.op5(spark, table(spark, sf_dir, "documents"))


def op6_licences(spark, sf_dir):
    return licences.op6(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.op7(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark, sf_dir):
    return bpe.op8(table(spark, sf_dir, "documents"))


def op9_langid(spark, sf_dir):
    return langid.op9(spark, table(spark, sf_dir, "documents"))


def op10_decontaminate(spark, sf_dir):
    return decontaminate.op10(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_neardup, op3_urls, op4_warc, op5_secrets, op6_licences, op7_toxicity, op8_bpe, op9_langid, op10_decontaminate, pipeline)
}
SQL = {"op1_quality": quality.OP1_SQL, "op2_neardup": neardup.OP2_SQL, "op3_urls": urls.OP3_SQL, "op4_warc": warc.OP4_SQL, "op5_secrets": secrets.OP5_SQL, "op6_licences": licences.OP6_SQL, "op10_decontaminate": decontaminate.OP10_SQL}
