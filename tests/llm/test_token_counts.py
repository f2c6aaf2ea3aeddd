from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import token_counts as tc
from factloom.llm.queries import tokenizer_file

from .texts import AWKWARD, documents

words = st.lists(st.integers(0, 2), min_size=1, max_size=5).map(tuple)


@settings(max_examples=500, deadline=None)
@given(st.sets(words, max_size=12), st.lists(st.integers(0, 3), max_size=20))
def test_automaton_equals_greedy_cutting(pieces, word):
    assert tc.Automaton(pieces).count(word) == tc.greedy(pieces, word)


def test_documents_against_brute_force(spark):
    pieces = set(tc.vocabulary(tokenizer_file()))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tc.token_counts(documents(spark, AWKWARD), tokenizer_file()).collect()}
    for k, text in enumerate(AWKWARD):
        found = (text or "").encode().lower().split()
        each = {w: tc.greedy(pieces, (*w, tc.END)) for w in set(found)}
        assert got[k] == (len(found), sum(map(each.__getitem__, found)))
    assert tc.token_counts(documents(spark, []), tokenizer_file()).count() == 0
