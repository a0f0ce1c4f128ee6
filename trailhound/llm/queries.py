"""The subpackage's queries by name, and the DuckDB SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailhound.llm import op11_collocations as phrases
from trailhound.llm import op12_spelling as spelling
from trailhound.llm.op1_hmm import op1_hmm
from trailhound.llm.op2_winnow import op2_winnow
from trailhound.llm.op3_minhash import op3_minhash
from trailhound.llm.op4_suffix_array import op4_suffix_array
from trailhound.llm.op5_bpe import op5_bpe
from trailhound.llm.op6_embeddings import op6_embeddings
from trailhound.llm.op7_packing import op7_packing
from trailhound.llm.op8_toxicity import op8_toxicity
from trailhound.llm.op9_language import op9_language
from trailhound.llm.op10_sharding import op10_sharding
from trailhound.llm.op13_neighbours import op13_neighbours

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hmm": op1_hmm,
    "op2_winnow": op2_winnow,
    "op3_minhash": op3_minhash,
    "op4_suffix_array": op4_suffix_array,
    "op5_bpe": op5_bpe,
    "op6_embeddings": op6_embeddings,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_language": op9_language,
    "op10_sharding": op10_sharding,
    "op11_collocations": phrases.op11_collocations,
    "op12_spelling": spelling.op12_spelling,
    "op13_neighbours": op13_neighbours,
}

ORACLES: dict[str, str] = {
    "op11_collocations": phrases.ORACLE,
    "op12_spelling": spelling.ORACLE,
}
