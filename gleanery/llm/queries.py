"""The queries of this subpackage, and the SQL to hold them against where there is one."""

from __future__ import annotations

from gleanery.llm import chat, mixing, packing, pieces, pq, quality, sharding, simhash, topk, toxicity

QUERIES = {
    "op1_simhash_golay": simhash.op1_simhash_golay,
    "op2_bounded_space_packing": packing.op2_bounded_space_packing,
    "op3_histogram_topk": topk.op3_histogram_topk,
    "op4_pq_near_duplicates": pq.op4_pq_near_duplicates,
    "op5_context_mixing": mixing.op5_context_mixing,
    "op6_perspective_rotation": chat.op6_perspective_rotation,
    "op7_rendezvous_shards": sharding.op7_rendezvous_shards,
    "op8_subword_quality": quality.op8_subword_quality,
    "op9_noisy_channel_toxicity": toxicity.op9_noisy_channel_toxicity,
    "op10_sampled_pieces": pieces.op10_sampled_pieces,
}
ORACLE_SQL = {
    "op3_histogram_topk": topk.OP3_SQL,
    "op4_pq_near_duplicates": pq.OP4_SQL,
    "op6_perspective_rotation": chat.OP6_SQL,
}
