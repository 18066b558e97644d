"""Plan helpers shared by all operators."""

from .ranking import dense_index, dense_index_by, dense_index_of_scan, running_sum_by, sum_before
from .scratch import Scratch, clear

__all__ = ["Scratch", "clear", "dense_index", "dense_index_by", "dense_index_of_scan", "running_sum_by", "sum_before"]
