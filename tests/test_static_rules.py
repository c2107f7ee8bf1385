"""Library-wide rules checked on the source: no local checkpoints, no pandas
conversion or RDDs in the library, and driver collects only where the result
is bounded (a one-row profile, fitted knots, a report)."""

import os
import re

ROOT = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "stayline")
ALLOWED_COLLECT = {("quality.py", "drop_sparse"), ("prep.py", "quantile_knots"), ("report.py", "with_p_values"),
                   ("clinical.py", "panel_labels"),
                   ("grid.py", "label_domain"),  # at most as many as a stated bound
                   ("tables.py", "list_names"),  # one name a table
                   ("joins.py", "events_in_stay")}  # levels of an interval index: at most 31 numbers


def _sources():
    for d, dirs, files in os.walk(ROOT):
        dirs[:] = [x for x in dirs if x != "llm"]  # has tests of its own
        for f in files:
            if f.endswith(".py"):
                p = os.path.join(d, f)
                yield f, open(p).read()


def test_no_local_checkpoint_pandas_or_rdd():
    for f, src in _sources():
        assert "localCheckpoint" not in src, f
        assert ".toPandas(" not in src, f
        assert ".rdd" not in src, f


def test_collect_only_for_bounded_results():
    for f, src in _sources():
        func = None
        for line in src.splitlines():
            m = re.match(r"def (\w+)\(", line)
            if m:
                func = m.group(1)
            if ".collect()" in line:
                assert (f, func) in ALLOWED_COLLECT, (f, func, line.strip())
