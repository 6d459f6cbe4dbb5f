"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import exact_dedup, fingerprints, jaccard_join, license_scan, packing, pieces, quality_net, sharding, toxicity, url_filter

QUERIES = {
    "op1_feistel_shards": sharding.op1,
    "op2_license_scan": license_scan.op2,
    "op3_jaccard_join": jaccard_join.op3,
    "op4_piece_ids": pieces.op4,
    "op5_quality_net": quality_net.op5,
    "op6_toxicity": toxicity.op6,
    "op7_exact_dedup": exact_dedup.op7,
    "op8_url_filter": url_filter.op8,
    "op9_best_fit_packing": packing.op9,
    "op10_merkle_fingerprints": fingerprints.op10,
}

ORACLES = {
    "op3_jaccard_join": jaccard_join.OP3_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
}
