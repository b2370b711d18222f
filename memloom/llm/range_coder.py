"""Adaptive context mixing with a range coder, in blocks that start from nothing.

The coder is a kernel in the JVM (java/Coder.java). Its model of a block mixes three predictions of the next id to one distribution:

* order 0, a binary tree over an id's bits whose nodes count adaptively how often each way was taken;
* order 1, the two ids that followed the last id most lately;
* order 2, the id that followed the last two ids.

Each pair of the confidences that order 1 and order 2 have (how often in a row they were right) has weights of its own. An id's probability
is the weighted sum of what the orders give it, and after each id its weights move by 1/32 towards the part that each order had in that
sum. The range coder (56 bits, bytes, with carries) codes the id as one interval of the mixed distribution. 2^-10 of it is
spread evenly, so that any id can be coded.

Two blocks are coded side by side, which hides the waits of each. Ids are integers of 1 to 20 bits; others raise. A null block gives null, an
empty one no ids. Coding is deterministic, in integers.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession

from memloom.llm import kernels

#: Ids in a block.
BLOCK = 1 << 15


def bits_of(vocabulary: int) -> int:
    """Bits of the ids of a vocabulary of this size."""
    return max(1, (vocabulary - 1).bit_length())


def kind(bits: int) -> str:
    """numpy's type of the ids that the coder takes and gives."""
    return "<u2" if bits <= 16 else "<u4"


def coded(spark: SparkSession, one: Column, n: Column, two: Column, m: Column, bits: Column) -> Column:
    """Two runs of n and m ids, n >= m, each id of kind(bits), to two coded blocks in one binary; see apart. The second may be null."""
    return kernels.coded(spark, one, n, two, m, bits)


def decoded(spark: SparkSession, one: Column, n: Column, two: Column, m: Column, bits: Column) -> Column:
    """The ids of two coded blocks in one binary; see apart."""
    return kernels.decoded(spark, one, n, two, m, bits)


def apart(both: bytes) -> tuple[bytes, bytes]:
    """The two parts of what the coder gives."""
    n = 4 + int.from_bytes(both[:4], "little")
    return both[4:n], both[n:]
