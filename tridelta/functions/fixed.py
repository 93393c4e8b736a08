"""Fixed values. These are this project's own deterministic start values
(integer-valued, so sums are exact in any order) and the reference's
default parameters, kept together here.

Fixed values:
  factor start value  c = (idx*7919 + col*104729 + (mode+1)) % 1000
  core start value    g = (p*31 + q*17 + r*7) % 97 + 1
  defaults            ranks (3,3,3), cut_num 12, mu 0.8, partition "bucket"
  mode count          3
  published core schedule, weight of each region's contribution:
                      100: 1, 010: 1, 001: 1, 011: 2, 101: 1, 110: 0, 111: 3
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FACTOR_IDX_MULT = 7919
FACTOR_COL_MULT = 104729
FACTOR_MOD = 1000
CORE_P, CORE_Q, CORE_R, CORE_MOD = 31, 17, 7, 97

DEFAULT_RANKS = (3, 3, 3)
DEFAULT_CUT_NUM = 12
DEFAULT_MU = 0.8
DEFAULT_PARTITION = "bucket"

PUBLISHED_CORE_WEIGHTS = {"100": 1, "010": 1, "001": 1, "011": 2, "101": 1, "110": 0, "111": 3}


def factor_value(idx: Column, col: int, mode: int) -> Column:
    return ((idx * F.lit(FACTOR_IDX_MULT) + F.lit(col * FACTOR_COL_MULT + mode + 1)) % F.lit(FACTOR_MOD)).cast("double")


def core_value_py(p: int, q: int, r: int) -> float:
    return float((p * CORE_P + q * CORE_Q + r * CORE_R) % CORE_MOD + 1)
