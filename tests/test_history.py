import datetime
import random

import pytest

from larkspur.operators import history as H

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(i, rng.choice([7] * 8 + [1, 2, None]), rng.choice([None, *(START + datetime.timedelta(hours=rng.randrange(900)) for _ in range(9))])) for i in range(6000)]
    df = spark.createDataFrame(rows, "id int, owner int, at timestamp_ntz")
    return rows, H.write_history(df, str(tmp_path_factory.mktemp("h")), "owner", "at", "id", file_rows=150, parts=8)


def wanted(rows, owner):
    own = [r for r in rows if r[1] == owner]
    return [r[0] for r in sorted(own, key=lambda r: (r[2] is None, -(r[2] - START).total_seconds() if r[2] else 0, r[0]))]


def test_pages_by_offset_read_few_files(spark, kept):
    rows, h = kept
    all_files = spark.read.parquet(f"{h.path}/rows").inputFiles()
    assert len(all_files) > 30
    for owner in (7, 1):
        ids = wanted(rows, owner)
        for limit, offset in ((20, 0), (100, 1234), (50, len(ids) - 10), (5, len(ids) + 5), (0, -3)):
            page = H.page_by_offset(h, owner, limit, offset)
            got = page.collect()
            limit, offset = max(1, limit), max(0, offset)
            assert [r.id for r in got] == ids[offset : offset + limit] and {r.total for r in got} <= {len(ids)}
            assert not got or len(page.inputFiles()) <= 3
    assert H.page_by_offset(h, 99, 10, 0).count() == 0


def test_pages_after_a_cursor_read_few_files_and_walk_through_all(spark, kept):
    rows, h = kept
    ids, at = wanted(rows, 7), {r[0]: r[2] for r in rows}
    page = H.page_after(h, 7, None, 40)
    assert [r.id for r in page.collect()] == ids[:40] and len(page.inputFiles()) <= 3
    for place in (39, 149, 1500, 2999):
        cursor = ids[place]
        if at[cursor] is not None:
            page = H.page_after(h, 7, (at[cursor], cursor), 40)
            got = page.collect()
            assert [r.id for r in got] == ids[place + 1 : place + 41] and all(r.has_more for r in got) and len(page.inputFiles()) <= 3
    last = [i for i in ids if at[i] is not None][-1]
    end = H.page_after(h, 7, (at[last], last), 10_000).collect()
    assert [r.id for r in end] == ids[ids.index(last) + 1 :] and not any(r.has_more for r in end)
