"""Operations of a training-data pipeline: counts, shards, mixes, filters, deduplication, tokens.

`QUERIES` and `ORACLES` hold what this package adds to the registered queries.
"""

from __future__ import annotations

from riskframe.llm.encoding import op10_sentencepiece
from riskframe.llm.extraction import op7_html
from riskframe.llm.mixing import op3_mixing
from riskframe.llm.negatives import ORACLE as NEGATIVES_SQL
from riskframe.llm.negatives import op11_hard_negatives
from riskframe.llm.personal import op13_personal_data
from riskframe.llm.quality import op4_quality_classifier
from riskframe.llm.repetition import op9_quality_rules
from riskframe.llm.sharding import op2_sharding
from riskframe.llm.simhash import op5_simhash
from riskframe.llm.tokens import op1_token_counts
from riskframe.llm.toxicity import op6_toxicity
from riskframe.llm.trie import ORACLE as TRIE_SQL
from riskframe.llm.trie import op12_conversation_trie
from riskframe.llm.vectors import ORACLE as EMBEDDINGS_SQL
from riskframe.llm.vectors import op8_embeddings

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_sharding,
        op3_mixing,
        op4_quality_classifier,
        op5_simhash,
        op6_toxicity,
        op7_html,
        op8_embeddings,
        op9_quality_rules,
        op10_sentencepiece,
        op11_hard_negatives,
        op12_conversation_trie,
        op13_personal_data,
    )
}
ORACLES = {"op8_embeddings": EMBEDDINGS_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_conversation_trie": TRIE_SQL}
