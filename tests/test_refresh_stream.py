"""The repeated refresh over clock steps, against a plain replay of all events at once."""

import json
from datetime import datetime, timedelta

from quarry.streaming import refresh

START = datetime(2024, 1, 1)


def day(n):
    return None if n is None else (START + timedelta(days=n)).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def put(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(("id", "at", "alive"), (i, day(d), a), strict=True))) + "\n" for i, d, a in events))


def got(spark, state):
    return sorted((r["id"], r["action"], (r["due"] - START).days, r["fail_count"]) for r in refresh.waiting(spark, state).collect())


def test_clock_steps(spark, tmp_path):
    source, state = tmp_path / "in", f"{tmp_path}/state"

    def run(now=None):
        refresh.refresh(spark, str(source), state, None if now is None else START + timedelta(days=now), days=7, most=2)
        return got(spark, state)

    put(source, "1.json", [("a", 0, None), ("b", 0, True), ("c", 0, False), ("a", 0, None), (None, 0, None), ("nobody", None, True)])
    first = [("a", "check", 0, 0)]
    assert run(0) == first
    put(source, "2.json", [("a", 3, True), ("b", 5, True), ("c", 4, False), ("d", 4, None)])
    second = sorted([*first, ("c", "purge", 4, 2), ("d", "check", 4, 0)])
    assert run(8) == second and run() == second  # the second run finds no new files
    put(source, "3.json", [("b", 9, False), ("b", 9, False), ("late", 1, None), ("b", 8, True)])
    third = sorted([*second, ("a", "check", 10, 0), ("d", "check", 11, 0), ("b", "check", 16, 1)])
    assert run(19) == third
    put(source, "4.json", [("a", 20, True), ("b", 20, True), ("d", 20, True)])
    assert run(24) == third and run(26) == third  # timers of before the checks are gone
    put(source, "5.json", [("c", 28, True)])
    assert run(28) == sorted([*third, ("a", "check", 27, 0), ("b", "check", 27, 0), ("d", "check", 27, 0)])
