"""The corpus queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from tidemark.llm import audit, bpe, html, lines, media, mixing, neardup, search, sharding, substrings, topk, toxicity, urls


def queries() -> dict:
    return {
        "op1_substrings": substrings.op1_substrings,
        "op2_bpe": bpe.op2_bpe,
        "op3_mixing": mixing.op3_mixing,
        "op4_urls": urls.op4_urls,
        "op5_html": html.op5_html,
        "op6_topk": topk.op6_topk,
        "op7_neardup": neardup.op7_neardup,
        "op8_media": media.op8_media,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_lines": lines.op10_lines,
        "op11_sharding": sharding.op11_sharding,
        "op12_audit": audit.op12_audit,
        "op13_search": search.op13_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.SQL, "op4_urls": urls.SQL, "op6_topk": topk.SQL, "op10_lines": lines.SQL, "op11_sharding": sharding.SQL, "op12_audit": audit.SQL, "op13_search": search.SQL}
