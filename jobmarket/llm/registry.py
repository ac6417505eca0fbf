"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from jobmarket.llm.bpe import op7_bpe
from jobmarket.llm.common import shipping
from jobmarket.llm.contexttree import op6_contexttree
from jobmarket.llm.divergence import OP11_SQL, op11_divergence
from jobmarket.llm.langid import op12_langid
from jobmarket.llm.mixing import OP5_SQL, op5_mixing
from jobmarket.llm.multiindex import op3_multiindex
from jobmarket.llm.orderhash import op4_orderhash
from jobmarket.llm.prefixtrie import op13_prefixtrie
from jobmarket.llm.sharding import op10_sharding
from jobmarket.llm.simhash import op1_simhash
from jobmarket.llm.substrings import op9_substrings
from jobmarket.llm.toxicity import op2_toxicity
from jobmarket.llm.warc import OP8_SQL, op8_warc

_OPERATORS = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_multiindex": op3_multiindex,
    "op4_orderhash": op4_orderhash,
    "op5_mixing": op5_mixing,
    "op6_contexttree": op6_contexttree,
    "op7_bpe": op7_bpe,
    "op8_warc": op8_warc,
    "op9_substrings": op9_substrings,
    "op10_sharding": op10_sharding,
    "op11_divergence": op11_divergence,
    "op12_langid": op12_langid,
    "op13_prefixtrie": op13_prefixtrie,
}
QUERIES = {name: shipping(run) for name, run in _OPERATORS.items()}
SQL = {"op5_mixing": OP5_SQL, "op8_warc": OP8_SQL, "op11_divergence": OP11_SQL}
