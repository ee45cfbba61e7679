import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarry.plans.language import NotIndexable, ParseError, Query, RegexError, UnknownField, literal_runs, plan


def test_text_form():
    q = Query.from_text("retry backoff repo:a/b,c -repo:d lang:rust case:yes scope:def in:hotset type:literal path:src")
    assert (q.pattern, q.repos, q.exclude_repos, q.langs, q.case, q.content_scope, q.repo_scope, q.paths) == ("retry backoff", ["a/b", "c"], ["d"], ["rust"], "sensitive", "definition", "hot_set", ["src"])
    assert Query.from_text(q.to_text()) == q


@given(st.lists(st.sampled_from(["alpha", "be_ta", "repo:x/y", "-lang:go", "lang:rust,go", "case:yes", "scope:test", "in:remote", "type:regex", "symbol:Foo", "-path:t"]), max_size=8))
def test_round_trip(tokens):
    q = Query.from_text(" ".join(tokens))
    assert Query.from_text(q.to_text()) == q


@pytest.mark.parametrize("text", ["Vec::new", "nope:1"])
def test_unknown_field(text):
    with pytest.raises(UnknownField):
        Query.from_text(text)


@pytest.mark.parametrize("text", ["x case:maybe", "x scope:all", "x in:here", "x type:glob"])
def test_bad_value(text):
    with pytest.raises(ParseError):
        Query.from_text(text)


def test_json_form():
    assert Query.from_json('{"pattern": "abc", "repos": ["x"]}').repos == ["x"]
    with pytest.raises(UnknownField):
        Query.from_json('{"pattern": "abc", "other": 1}')
    for bad in ("[1]", "{", '{"pattern": 3}', '{"pattern": "abc", "repos": "x"}'):
        with pytest.raises(ParseError):
            Query.from_json(bad)


@pytest.mark.parametrize("pattern", [r"(abc)\1", "(?=abc)abc", "(?<!a)abc", "abc*+", "(?>abc)", "(abc"])
def test_dialect(pattern):
    with pytest.raises(RegexError):
        Query(pattern, kind="regex").validate()


def test_indexable():
    with pytest.raises(NotIndexable):
        Query("a.b", kind="regex").validate()
    with pytest.raises(NotIndexable):
        Query("ab").validate()
    with pytest.raises(ParseError):
        Query("").validate()
    Query(r"fn visit_\w+", kind="regex").validate()
    assert literal_runs(r"foob?ar\.x[abc]+yz") == ["foo", "ar.x", "yz"]


def test_plan():
    assert [b for b, _ in plan(Query("abc"))] == ["local_index", "grep_app", "github", "sourcegraph"]
    assert [b for b, _ in plan(Query("abc", repo_scope="hot_set"))] == ["local_index"]
