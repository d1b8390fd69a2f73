"""Settings of an engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass

from .plans.bounds import Chain, RangeError, resolve_start
from .plans.segments import Segment, chain_of


@dataclass(frozen=True)
class EngineConfig:
    """Checked when made; gives the chain's state and a store's start."""

    shard_size: int = 200
    start_block: int = 0
    stop_block: int = 0
    head_delay_tolerance: int = 0
    lib_delay_tolerance: int = 0
    truncation_low_block_num: int = 0
    #: how many stores must have a block irreversible before older ones may drop it
    truncation_threshold: int = 1
    first_streamable_block: int = 0

    def __post_init__(self) -> None:
        if self.shard_size < 1:
            raise ValueError("a shard holds one block at least")
        if min(self.stop_block, self.head_delay_tolerance, self.lib_delay_tolerance, self.first_streamable_block) < 0 or self.truncation_threshold < 1:
            raise ValueError("only the start and the lowest block served may be negative, and the threshold is one at least")
        if self.stop_block and 0 <= self.start_block >= self.stop_block:
            raise RangeError(f"stop block {self.stop_block} is not above start block {self.start_block}")

    def chain(self, segments: list[Segment]) -> Chain:
        return chain_of(
            segments, truncation=self.truncation_low_block_num, head_tolerance=self.head_delay_tolerance,
            irreversible_tolerance=self.lib_delay_tolerance, first_streamable=self.first_streamable_block,
        )

    def start(self, irreversible: int) -> int:
        if self.start_block == self.first_streamable_block:
            return self.start_block
        return resolve_start(self.start_block, irreversible, self.shard_size)
