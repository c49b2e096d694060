"""Registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audio_fingerprint import op1_audio_fingerprint
from .centroid_clustering import OP11_SQL, op11_centroid_clustering
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .html_text import op8_html_text
from .knn_join import OP5_SQL, op5_knn_join
from .language_id import op7_language_id
from .minhash_dedup import OP2_SQL, op2_near_dedup
from .packing import op10_packing
from .piece_codec import op6_piece_codec
from .secret_scan import op12_secret_scan
from .suffix_dedup import op4_suffix_dedup
from .toxicity import op3_toxicity
from .warc import op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_audio_fingerprint": op1_audio_fingerprint,
        "op2_near_dedup": op2_near_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_knn_join": op5_knn_join,
        "op6_piece_codec": op6_piece_codec,
        "op7_language_id": op7_language_id,
        "op8_html_text": op8_html_text,
        "op9_warc": op9_warc,
        "op10_packing": op10_packing,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_secret_scan": op12_secret_scan,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": OP2_SQL, "op5_knn_join": OP5_SQL, "op11_centroid_clustering": OP11_SQL, "op13_hard_negatives": OP13_SQL}
