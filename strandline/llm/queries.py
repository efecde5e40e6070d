"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import edit_embedding, html, language, minhash, mixing, oracles, pieces, pii, repeats, tiff, warc
from .common import ship


def _shipped(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    run.__name__ = f.__name__
    run.__doc__ = f.__doc__
    return run


QUERIES = {f.__name__: _shipped(f) for f in (
    warc.op1_warc,
    pii.op2_pii,
    pieces.op3_sentencepiece,
    minhash.op4_minhash,
    language.op5_language,
    mixing.op6_mixing,
    html.op7_html,
    tiff.op8_tiff,
    repeats.op9_repeats,
    edit_embedding.op10_fingerprint,
)}

ORACLES = {"op1_warc": oracles.WARC, "op4_minhash": oracles.MINHASH, "op6_mixing": mixing.ORACLE}
