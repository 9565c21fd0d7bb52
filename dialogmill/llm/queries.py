"""The queries of this folder and their SQL."""

from __future__ import annotations

from dialogmill.llm.bpe import op7_bpe
from dialogmill.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from dialogmill.llm.license_scan import OP13_SQL, op13_license_scan
from dialogmill.llm.line_dedup import OP3_SQL, op3_line_dedup
from dialogmill.llm.media import op9_media
from dialogmill.llm.mixing import OP2_SQL, op2_mixing
from dialogmill.llm.quality_rules import OP1_SQL, op1_quality_rules
from dialogmill.llm.sharding import op5_sharding
from dialogmill.llm.simhash import op10_simhash
from dialogmill.llm.spelling import OP11_SQL, op11_spelling_variants
from dialogmill.llm.token_counts import op8_token_counts
from dialogmill.llm.url_filter import op4_sql, op4_url_filter
from dialogmill.llm.weak_label import op6_quality_classifier

QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_mixing, op3_line_dedup, op4_url_filter, op5_sharding, op6_quality_classifier, op7_bpe, op8_token_counts, op9_media, op10_simhash, op11_spelling_variants, op12_fill_in_middle, op13_license_scan)
}
SQL = {"op1_quality_rules": OP1_SQL, "op2_mixing": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_url_filter": op4_sql(), "op11_spelling_variants": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_license_scan": OP13_SQL}
