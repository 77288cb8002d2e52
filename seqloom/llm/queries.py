"""Queries of this subpackage: one for each operator, over its whole table."""
from . import op1_decontam, op2_pii, op3_mixing, op4_quality, op5_neardup, op6_warc, op7_langid, op8_tokencount, op9_html, op10_tokenids

QUERIES = {
    "op1_decontam": op1_decontam.query,
    "op2_pii": op2_pii.query,
    "op3_mixing": op3_mixing.query,
    "op4_quality": op4_quality.query,
    "op5_neardup": op5_neardup.query,
    "op6_warc": op6_warc.query,
    "op7_langid": op7_langid.query,
    "op8_tokencount": op8_tokencount.query,
    "op9_html": op9_html.query,
    "op10_tokenids": op10_tokenids.query,
}
ORACLES: dict[str, str] = {"op4_quality": op4_quality.SQL, "op6_warc": op6_warc.SQL}
