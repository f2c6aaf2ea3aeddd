from factloom import questions as q


def test_plans_are_checked():
    plan = {"material": " медь ", "process": 5, "year_min": "2015", "year_max": 3000, "conditions": [{"parameter": "t", "value_min": "5", "value_max": True, "unit": " "}, {"x": 1}, "y"], "target": {"parameter": ""}, "entities": [{"type": "Process", "name": "обжиг"}, {"type": "Odd", "name": "x"}, {"type": "Process", "name": " "}]}
    got = q.parse("?", plan, 2026)
    assert (got.material, got.process, got.year_min, got.year_max, got.target) == ("медь", None, 2015, None, None)
    assert got.conditions == (q.Condition("t", 5.0, None, None),) and got.entities == (("Process", "обжиг"),)
    assert q.parse("?", {"conditions": None, "entities": "x"}, 2026) == q.Question("?")


def test_events_in_any_pieces():
    def broken():
        yield "a"
        raise RuntimeError("cut")

    sent = "".join(q.events({"n": 1}, broken(), lambda error: {"error": error}))
    for size in (1, 7, 1000):
        got = list(q.read_events(sent[k : k + size] for k in range(0, len(sent), size)))
        assert got == [("evidence", {"n": 1}), ("delta", {"text": "a"}), ("final", {"error": "RuntimeError: cut"})]


def test_open_citations_are_held_back():
    assert q.hold_back("a [1] b [2") == ("a [1] b ", "[2") and q.hold_back("a [1]") == ("a [1]", "") and q.hold_back("x [" + "1" * 300) == ("x [" + "1" * 300, "")
