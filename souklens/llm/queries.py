"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from souklens.llm.addressable import op4_addressable_codes
from souklens.llm.balltree import op12_ball_tree
from souklens.llm.decontaminate import op6_positional_index
from souklens.llm.embeddings import op9_int8_tiles
from souklens.llm.lm import op8_stupid_backoff
from souklens.llm.minhash import op2_minhash
from souklens.llm.oracles import ORACLES  # noqa: F401
from souklens.llm.packing import op7_sum_of_squares
from souklens.llm.pages import op5_template_removal
from souklens.llm.pii import op1_anchor_expansion
from souklens.llm.quality import op10_line_field
from souklens.llm.sharding import op3_hypergeometric
from souklens.llm.topk import op11_histogram_selection
from souklens.llm.vector_codes import op13_equal_average

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_anchor_expansion": op1_anchor_expansion,
    "op2_minhash": op2_minhash,
    "op3_hypergeometric": op3_hypergeometric,
    "op4_addressable_codes": op4_addressable_codes,
    "op5_template_removal": op5_template_removal,
    "op6_positional_index": op6_positional_index,
    "op7_sum_of_squares": op7_sum_of_squares,
    "op8_stupid_backoff": op8_stupid_backoff,
    "op9_int8_tiles": op9_int8_tiles,
    "op10_line_field": op10_line_field,
    "op11_histogram_selection": op11_histogram_selection,
    "op12_ball_tree": op12_ball_tree,
    "op13_equal_average": op13_equal_average,
}
