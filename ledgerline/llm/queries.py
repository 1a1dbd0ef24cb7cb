"""Queries of this package over the given tables, and the SQL of those that have one."""

from __future__ import annotations

from ledgerline.llm.blob_secrets import op5_secrets
from ledgerline.llm.chat_repair import op1_chat_repair
from ledgerline.llm.decontaminate import OP8_SQL, op8_decontaminate
from ledgerline.llm.fill_middle import op13_fill_middle
from ledgerline.llm.graph_search import op2_graph_search
from ledgerline.llm.metric_tree import op11_metric_tree
from ledgerline.llm.mixing import OP3_SQL, op3_mixing
from ledgerline.llm.ngram_join import OP6_SQL, op6_ngram_join
from ledgerline.llm.pii import op4_pii
from ledgerline.llm.quality import op7_quality
from ledgerline.llm.token_records import op10_token_records
from ledgerline.llm.token_sections import op9_token_sections
from ledgerline.llm.whitening import op12_whitening

QUERIES = {
    query.__name__: query
    for query in (
        op1_chat_repair, op2_graph_search, op3_mixing, op4_pii, op5_secrets, op6_ngram_join, op7_quality, op8_decontaminate,
        op9_token_sections, op10_token_records, op11_metric_tree, op12_whitening, op13_fill_middle,
    )
}

# The others learn, search approximately, or add spans and tokens of their own: tests hold them against brute force.
ORACLE_SQL = {"op3_mixing": OP3_SQL, "op6_ngram_join": OP6_SQL, "op8_decontaminate": OP8_SQL}
