"""Calls that fail or are slow, and the cache of vectors."""

from functools import partial

from factloom.operators import calls


class Clock:
    def __init__(self):
        self.now, self.waits = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.waits.append(seconds)
        self.now += seconds


def run(texts, clients, clock, budget=100.0, tries=3):
    return calls.answers(texts, clients, budget, tries, 0.6, 1.0, clock, clock.sleep)


def test_repeats_back_off_and_only_what_failed_is_asked_again():
    clock, seen = Clock(), []

    def client(texts, left):
        seen.append(list(texts))
        if len(seen) == 1:
            raise OSError("down")
        return [t.upper() if t != "b" or len(seen) == 3 else None for t in texts]

    assert run(["a", "b"], [("one", client)], clock) == [("A", "one", 2, None), ("B", "one", 3, None)]
    assert seen == [["a", "b"], ["a", "b"], ["b"]] and clock.waits == [1.0, 2.0]


def test_a_slow_primary_leaves_time_for_the_second():
    clock, allowed = Clock(), []

    def slow(texts, left):
        allowed.append(("slow", left))
        clock.now += left + 1
        raise TimeoutError("late")

    def second(texts, left):
        allowed.append(("second", left))
        return [t + "!" for t in texts]

    assert run(["a"], [("slow", slow), ("second", second)], clock) == [("a!", "second", 2, None)]
    assert allowed == [("slow", 60.0), ("second", 39.0)]


def test_failures_are_rows_with_their_error():
    def bad(texts, left):
        raise ValueError("no")

    clock = Clock()
    assert run(["a"], [("one", bad), ("two", bad)], clock) == [(None, "two", 6, "ValueError: no")]
    assert run(["a"], [("one", lambda t, left: [])], Clock()) == [(None, "one", 3, "0 answers for 1 texts")]
    assert run(["a"], [("one", bad)], Clock(), budget=0.0) == [(None, None, 0, "not asked")]


def _clients(log, fails=()):
    def client(texts, left):
        with open(log, "a") as f:
            f.write("".join(f"{len(texts)} {t}\n" for t in texts))
        return [None if t in fails else t[::-1] for t in texts]

    return [("one", client)]


def test_batches_of_sixteen_and_only_missing_rows(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(k, None if k == 7 else f"t{k}") for k in range(40)], "window_id long, prompt string").coalesce(1)
    done = spark.createDataFrame(calls.ask(rows, partial(_clients, log, ("t3",)), pause_s=0.0).collect(), "window_id long, answer string, model string, tries int, error string")
    sizes = [int(line.split()[0]) for line in open(log)]
    assert max(sizes) == 16 and sorted(done.where("answer is null").select("window_id", "tries", "error").collect()) == [(3, 3, "no answer"), (7, 0, "no text")]
    assert sorted(r.window_id for r in calls.unanswered(rows, done).collect()) == [3, 7]


def _vectors(log, fails=()):
    def client(texts, left):
        with open(log, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return [None if t in fails else [float(len(t)), 1.0] for t in texts]

    return [("one", client)]


def test_cache_asks_once_and_forgets_the_oldest(spark, tmp_path):
    log = str(tmp_path / "log")
    asked = lambda: sorted(open(log).read().split("\n")[:-1]) if (tmp_path / "log").exists() else []
    cache = calls.VectorCache(spark, str(tmp_path / "cache"), most=3)
    rows = lambda *r: spark.createDataFrame(list(r), "id long, kind string, text string")
    first = cache.embed(rows((1, "document", "aa"), (2, "document", "aa"), (3, "query", "aa"), (4, "document", "bad"), (5, "document", None)), partial(_vectors, log, ("bad",)), 1, pause_s=0.0)
    assert sorted((r.id, r.kind, r.embedding) for r in first.collect()) == [(1, "document", [2.0, 1.0]), (2, "document", [2.0, 1.0]), (3, "query", [2.0, 1.0]), (4, "document", None), (5, "document", None)]
    assert asked() == ["aa", "aa", "bad", "bad", "bad"]
    cache.embed(rows((1, "document", "aa"), (2, "document", "bad")), partial(_vectors, log), 10).collect()
    assert asked() == ["aa", "aa", "bad", "bad", "bad", "bad"]
    # Three are kept: the query's vector, used in turn 1 only, makes room.
    cache.embed(rows((1, "document", "cccc")), partial(_vectors, log), 20).collect()
    assert sorted((r.kind, r.used) for r in cache.read().collect()) == [("document", 10), ("document", 10), ("document", 20)]
