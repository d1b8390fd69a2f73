import pytest

from ledgerseek.plans.bounds import UNBOUNDED, Chain, Cursor, LegacyRequest, Mode, RangeError, Request, covers_fully, resolve, resolve_start
from ledgerseek.plans.segments import BackendOptions, Segment, backend_options, chain_of, check_archive_request, is_covered, next_slice, nth_highest_irreversible, plan

C = Chain(2000, 1800)


@pytest.mark.parametrize("request_, chain, want", [
    (LegacyRequest(100, 200), C, (100, 300)), (LegacyRequest(100, 5000), C, (100, 5100)), (LegacyRequest(300, 200, True), C, (100, 300)), (LegacyRequest(0, 200, True), C, (1600, 1800)),
    (LegacyRequest(0, 100), C, (1, 101)), (Request(low=5), C, (5, UNBOUNDED)), (Request(low=-31, high=-1), C, (1770, 1800)),
    (Request(1, -239, True, True), Chain(2000, 1800, 1000, first_streamable=2), (1000, 1762)), (Request(-239, None, True, True), C, (1762, 2000)),
    (Request(20, 101, cursor=Cursor(43)), C, (43, 101)), (Request(20, 101, cursor=Cursor(12)), C, (12, 101)), (Request(20, 1000, cursor=Cursor(203)), Chain(2000, 1800, 200), (203, 1000)),
    (Request(20, 101, True, cursor=Cursor(43)), C, (20, 43)), (Request(0, 9), Chain(50, 40, first_streamable=2), (2, 9)), (Request(high=7, descending=True), Chain(10, 9, -8), (2, 7)),
])
def test_ranges(request_, chain, want):
    got = resolve(request_, chain)
    assert (got.low, got.high) == want
    assert got.mode is (Mode.PAGINATED if isinstance(request_, LegacyRequest) else Mode.STREAMING)


@pytest.mark.parametrize("request_, chain", [
    (LegacyRequest(1, 0), C), (LegacyRequest(1801, 5), C), (LegacyRequest(5, 5), Chain(2000, 1800, 10)), (LegacyRequest(5, 5, True), Chain(2000, 1800, 10)), (Request(5, 1801, True), C),
    (Request(1801), C), (Request(-5000), C), (Request(5, high=-5000), C), (Request(50, 40), C), (Request(5), Chain(2000, 1800, 10)), (Request(5, 90, True), Chain(2000, 1800, 10)),
    (Request(20, 101, cursor=Cursor(203)), C), (Request(20, 101, True, cursor=Cursor(12)), C), (Request(20, cursor=Cursor(12)), Chain(2000, 1800, 15)),
])
def test_bad_ranges(request_, chain):
    with pytest.raises(RangeError):
        resolve(request_, chain)


def test_cursor():
    assert Cursor.parse("1:10:abc124:trx2") == Cursor(10, "abc124", "trx2") and Cursor.parse("1:4::trx1") == Cursor(4, "", "trx1") and Cursor.parse("") is None
    assert str(Cursor(5, "h", "0123456789abcdef")) == "1:5:h:0123456789ab"
    for bad in ("lib:4:", "2:4::trx1", "1:4:trx1", "1:x::a"):
        with pytest.raises(ValueError):
            Cursor.parse(bad)


def test_starts_and_coverage_of_shards():
    assert resolve_start(-250, 1000, 100) == 700 and resolve_start(-5000, 1000, 100) == 0 and resolve_start(300, 1000, 100) == 300
    with pytest.raises(RangeError):
        resolve_start(301, 1000, 100)
    assert covers_fully(0, 99, 0, 99) and not covers_fully(1, 99, 0, 99)


OLD, NEWER = Segment("old", 0, 499, 499, 1), Segment("new", 400, 990, 990, 2)
LIVE = Segment("live", 980, 1000, 1010, 3, reversible=True)


def test_plans():
    cut = lambda got: ([(s.segment.id, s.low, s.high) for s in got[0]], got[1])
    assert cut(plan([OLD, NEWER, LIVE], 100, 1005, reversible=True)) == ([("old", 100, 499), ("new", 500, 990), ("live", 991, 1005)], True)
    assert cut(plan([OLD, NEWER, LIVE], 100, 1005, True, True)) == ([("live", 980, 1005), ("new", 400, 979), ("old", 100, 399)], True)
    assert cut(plan([OLD], 100, 700)) == ([("old", 100, 499)], False)
    assert cut(plan([OLD, LIVE], 985, 1050, reversible=True)) == ([("live", 985, 1050)], False)
    assert next_slice([Segment("x", 0, 9, 9, ready=False)], 1, 5) is None
    assert next_slice([OLD, Segment("a", 0, 499, 499, 1)], 1, 5).segment.id == "a"


def test_chain_and_options():
    c = chain_of([OLD, NEWER, LIVE], truncation=5)
    assert (c.head, c.irreversible, c.lowest) == (1010, 1000, 5)
    with pytest.raises(RangeError):
        chain_of([])
    live = backend_options(LIVE, False, True, Mode.PAGINATED, 7, "c")
    assert live == BackendOptions(True, True, 7, "c") and backend_options(OLD, False, True, Mode.PAGINATED, 7, "c") == BackendOptions(False, False, 0, "")
    check_archive_request(backend_options(OLD, False, True, Mode.PAGINATED, 7, "c"))
    with pytest.raises(RangeError):
        check_archive_request(live)


def test_coverage_and_nth():
    assert is_covered([OLD, NEWER, LIVE], 1010, 0) and not is_covered([OLD, LIVE], 1010, 0) and is_covered([LIVE], 1010, -20) and not is_covered([], 5, 0)
    moving = [Segment(str(n), 0, n, n, moving_head=True) for n in (5, 9, 7)]
    assert nth_highest_irreversible(moving, 2) == 7 and nth_highest_irreversible(moving, 4) is None
