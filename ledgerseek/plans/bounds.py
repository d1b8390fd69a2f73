"""Block ranges and cursors: pure driver-side arithmetic from a request to ``[low, high]``."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

UNBOUNDED = 9_000_000_000_000_000_000
PREFIX_LENGTH = 12


class Mode(Enum):
    STREAMING = "streaming"
    PAGINATED = "paginated"


class RangeError(ValueError):
    """A request that asks for blocks that can't be served."""


@dataclass(frozen=True)
class Cursor:
    """Place after which a listing goes on: ``1:<block>:<head id>:<transaction prefix>``."""

    block: int
    head_id: str = ""
    trx_prefix: str = ""

    def __str__(self) -> str:
        return f"1:{self.block}:{self.head_id}:{self.trx_prefix[:PREFIX_LENGTH]}"

    @staticmethod
    def parse(text: str) -> Cursor | None:
        """None for an empty text; ValueError for anything else that is no cursor."""
        if not text:
            return None
        parts = text.split(":")
        if len(parts) != 4:
            raise ValueError(f"a cursor has four parts: {text!r}")
        if parts[0] != "1":
            raise ValueError(f"unknown version of cursor: {text!r}")
        if not (parts[1].isascii() and parts[1].isdigit()):
            raise ValueError(f"a cursor's block is a number: {text!r}")
        return Cursor(int(parts[1]), parts[2], parts[3])


@dataclass(frozen=True)
class Chain:
    """What is known of the chain: head, last irreversible block, and what is served."""

    head: int
    irreversible: int
    truncation: int = 0  # lowest block served; negative: relative to the head
    head_tolerance: int = 0
    irreversible_tolerance: int = 0
    first_streamable: int = 0

    @property
    def lowest(self) -> int:
        if self.truncation < 0:
            return max(0, self.head + self.truncation)
        return self.truncation

    def tip(self, reversible: bool) -> tuple[int, int]:
        """(virtual head, tolerance)."""
        return (self.head, self.head_tolerance) if reversible else (self.irreversible, self.irreversible_tolerance)


@dataclass(frozen=True)
class Request:
    """Bounds of a request: negative ones are relative to the virtual head (-1 is the head itself), None is unbounded."""

    low: int | None = None
    high: int | None = None
    descending: bool = False
    reversible: bool = False
    mode: Mode = Mode.STREAMING
    cursor: Cursor | None = None


@dataclass(frozen=True)
class LegacyRequest:
    """``count`` blocks from ``start`` on (0: the first block, or the head if descending)."""

    start: int
    count: int
    descending: bool = False
    reversible: bool = False
    cursor: Cursor | None = None


@dataclass(frozen=True)
class Range:
    low: int
    high: int
    mode: Mode


def resolve(request: Request | LegacyRequest, chain: Chain) -> Range:
    """Absolute range of a request, narrowed by its cursor; raises :class:`RangeError`."""
    found = _legacy(request, chain) if isinstance(request, LegacyRequest) else _modern(request, chain)
    found = _at_cursor(found, request.cursor, request.descending, chain.lowest)
    return replace(found, low=max(found.low, chain.first_streamable))


def _modern(r: Request, chain: Chain) -> Range:
    tip, slack = chain.tip(r.reversible)
    absolute = lambda n: tip + n + 1 if n < 0 else n
    low = chain.lowest if r.low is None else absolute(r.low)
    high = absolute(r.high) if r.high is not None else tip if r.descending else UNBOUNDED
    ahead = tip + slack
    if r.descending and high > ahead:
        raise RangeError(f"high block {high} is beyond the {'head' if r.reversible else 'last irreversible'} block {tip}")
    if low > ahead:
        raise RangeError(f"low block {low} is beyond the {'head' if r.reversible else 'last irreversible'} block {tip}")
    if low < 0:
        raise RangeError(f"low block {r.low} reaches below the first block")
    if low < chain.lowest:
        if not r.descending and r.cursor is None:
            raise RangeError(f"low block {low} is below the lowest block served, {chain.lowest}")
        if r.descending and r.low is not None and low > chain.first_streamable:
            raise RangeError(f"low block {low} of a descending request is below the lowest block served, {chain.lowest}")
        low = chain.lowest
    if high < 0:
        raise RangeError(f"high block {r.high} reaches below the first block")
    if high < low:
        raise RangeError(f"high block {high} is below low block {low}")
    return Range(low, high, r.mode)


def _legacy(r: LegacyRequest, chain: Chain) -> Range:
    tip, slack = chain.tip(r.reversible)
    lowest = chain.lowest
    if r.count == 0:
        raise RangeError("the block count can't be 0")
    if r.start > tip + slack:
        raise RangeError(f"start block {r.start} is beyond block {tip}; 0 follows it")
    if r.descending:
        high = r.start or tip
        if high < lowest:
            raise RangeError(f"start block {high} is below the lowest block served, {lowest}")
        return Range(max(high - r.count, lowest, 1), high, Mode.PAGINATED)
    if r.start and r.start < lowest and r.cursor is None:
        raise RangeError(f"start block {r.start} is below the lowest block served, {lowest}")
    low = r.start or lowest or 1
    return Range(low, min(low + r.count, UNBOUNDED), Mode.PAGINATED)


def _at_cursor(found: Range, cursor: Cursor | None, descending: bool, lowest: int) -> Range:
    """Ascending requests start at the cursor's block, even below the range; descending ones end there."""
    if cursor is None:
        return found
    at = cursor.block
    if at > found.high or (descending and at < found.low):
        raise RangeError(f"the cursor's block {at} is outside the range [{found.low}, {found.high}]")
    if at < lowest:
        raise RangeError(f"the cursor's block {at} is below the lowest block served, {lowest}")
    if not at:
        return found
    return replace(found, high=at) if descending else replace(found, low=at)


def resolve_start(start: int, irreversible: int, shard_size: int) -> int:
    """Start of a store: negative is relative to the last irreversible block and goes down to a shard's start; positive must be one."""
    if start < 0:
        at = max(0, irreversible + start)
        return at - at % shard_size
    if start % shard_size:
        raise RangeError(f"start block {start} is not the start of a shard of {shard_size} blocks")
    return start


def covers_fully(low: int, high: int, shard_start: int, shard_end: int) -> bool:
    """Whether a request reads a whole shard, so that an empty result says something about it."""
    return low <= shard_start and high >= shard_end
