"""Tables in the shared folder and their end."""

import os

from spanloom import shared


def test_scope_and_release(spark):
    kept = shared.written(spark.range(5), "kept")
    with shared.scope():
        a, b = shared.written(spark.range(3), "a"), shared.written(spark.range(4), "b")
        paths = [x._spanloom_path.removeprefix("file://") for x in (kept, a, b)]
        assert all(map(os.path.isdir, paths)) and a.count() == 3
        shared.release(a)
        assert not os.path.isdir(paths[1]) and b.count() == 4
    assert [os.path.isdir(p) for p in paths] == [True, False, False] and kept.count() == 5
    shared.release(kept)
    assert not os.path.isdir(paths[0])
