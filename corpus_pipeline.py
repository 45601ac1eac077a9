"""The corpus pipeline: quality rules, near-duplicates, repeated passages,
benchmark passages, target mix.  Each stage works on all that the stage before
kept; all but the last return the columns of ``documents``.

``run`` applies the stages in turn, writing each result to the shared folder
and reading it back, so that a lost executor costs one stage at most.  Near
duplicates by SimHash cannot be expressed in SQL, so ``ORACLE_SQL`` is None.
"""

from __future__ import annotations

from seqforge.llm import common, decontaminate, mixing, quality, simhash, substring_dedup


def quality_rules(spark, docs, sf_dir):
    return quality.keep_good(docs)


def simhash_near_dedup(spark, docs, sf_dir):
    return simhash.keep_one_of_each(docs)


def substring_dedup_stage(spark, docs, sf_dir):
    return substring_dedup.keep_unrepeated(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark, docs, sf_dir):
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup_stage),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mix_to_targets),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage-{k}")
    return docs
