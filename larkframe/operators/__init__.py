"""Reusable DataFrame kernels: aggregates, semi-join aggregates, peers, ranks and running sums."""

from larkframe.operators.aggregate import global_agg, group_agg, semi_join_agg
from larkframe.operators.ordered import dense_rank, peer_starts, rank, row_number, running_sum

__all__ = ["dense_rank", "global_agg", "group_agg", "peer_starts", "rank", "row_number", "running_sum", "semi_join_agg"]
