"""Registered block queries (P7, W5, P8 for blocks)."""

from __future__ import annotations

from reportlake.operators import blocks as B
from reportlake.operators import schedule as SC
from reportlake.plans.registry import query
from reportlake.sources import fixtures as FX


@query("block_defaults")
def q_block_defaults(spark, d):
    return B.block_defaults(FX.fx_blocks_full(spark, d))


@query("pair_half_blocks")
def q_pair_half_blocks(spark, d):
    return B.pair_half_blocks(FX.fx_blocks(spark, d))


@query("block_violations")
def q_block_violations(spark, d):
    return SC.block_violations(FX.fx_blocks_full(spark, d))
