"""Queries of the corpus operators and their SQL, by name."""

from . import alignment, context_mixing, cuckoo, decontaminate, hilbert, host_rules, line_dedup, lsh_forest, packing, perspectives, quality, sstable, wand

QUERIES = {
    "op1_context_mixing": context_mixing.op1_context_mixing,
    "op2_sstable": sstable.op2_sstable,
    "op3_host_rules": host_rules.op3_host_rules,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_quality": quality.op5_quality,
    "op6_hilbert_shards": hilbert.op6_hilbert_shards,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_perspectives": perspectives.op9_perspectives,
    "op10_lsh_forest": lsh_forest.op10_lsh_forest,
    "op11_alignment": alignment.op11_alignment,
    "op12_cuckoo_dedup": cuckoo.op12_cuckoo_dedup,
    "op13_wand_search": wand.op13_wand_search,
}

SQL = {
    "op3_host_rules": host_rules.OP3_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op9_perspectives": perspectives.OP9_SQL,
    "op12_cuckoo_dedup": cuckoo.OP12_SQL,
    "op13_wand_search": wand.OP13_SQL,
}
