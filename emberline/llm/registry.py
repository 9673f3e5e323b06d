"""The queries of this subpackage and their SQL."""

from emberline.llm import chat_format, decontaminate, host_quality, licenses, near_dedup, pack, prefix_trie, repair, suffix_dedup, toxicity, url_filter, warc, weak_quality

QUERIES = {
    "op1_host_quality": host_quality.op1_host_quality,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_warc": warc.op3_warc,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_weak_quality": weak_quality.op7_weak_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_pack": pack.op10_pack,
    "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_repair": repair.op13_repair,
}
SQL = {
    "op1_host_quality": host_quality.SQL,
    "op2_decontaminate": decontaminate.SQL,
    "op3_warc": warc.SQL,
    "op5_url_filter": url_filter.SQL,
    "op6_license_scan": licenses.SQL,
    "op9_chat_format": chat_format.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_repair": repair.SQL,
}
