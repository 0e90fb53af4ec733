import numpy as np
import pytest

from scoreloom.llm import url_filter as U
from tests.llm.util import SF, by_sql, rows_of


def judge(spark, pages, **options):
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string, verdict string")
    return {r.page_id: r for r in U.judge_urls(df, U.rules_frame(spark), **options).collect()}


def page(i, url, html=None):
    return (i, url, html, "clash", "clash")


def test_hosts_paths_and_rules(spark):
    got = judge(spark, [
        page(1, "HTTP://A.Example.COM/en/x?q#f"), page(2, "http://www.example.com/en/"), page(3, "x://example.com/en"), page(4, "http://b.net/es/1"),
        page(5, "http://b.net/de/1"), page(6, None), page(7, "no scheme/at all"), page(8, "http://example.com?x=://y/z"), page(9, "http://notcom/"),
        page(10, "a://b://c"), page(11, ""), page(12, "http://É.com/"),
    ])
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(1, 13)] == [
        ("a.example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("example.com", "/en", "com/"),
        ("b.net", "/es/1", "net/es/"), ("b.net", "/de/1", None), ("", "", None), ("", "", None), ("example.com", "", None), ("notcom", "/", None),
        ("b:", "//c", None), ("", "", None), ("É.com", "/", "com/"),
    ]
    assert {i: got[i].verdict for i in (1, 2, 3, 4, 6, 7, 9)} == {1: "block", 2: "allow", 3: "allow", 4: "block", 6: "allow", 7: "allow", 9: "allow"}


def rank(hosts, edges, seeds, damping=U.DAMPING, rounds=U.ROUNDS):
    n = {h: k for k, h in enumerate(hosts)}
    move, base = np.zeros((len(hosts), len(hosts))), np.zeros(len(hosts))
    for (a, b), c in edges.items():
        move[n[b], n[a]] += c
    out = move.sum(axis=0)
    move = move / np.where(out > 0, out, 1)
    for s in seeds:
        base[n[s]] = 1 / len(seeds)
    r = base.copy()
    for _ in range(rounds):
        came = damping * move @ r
        r = came + base * (1 - came.sum())
    return dict(zip(hosts, r))


def test_trust_follows_links_and_distrust_runs_back(spark):
    link = lambda *hosts: "".join(f'<a class="x" HREF="http://{h}/p">z</a>' for h in hosts)
    pages = [
        page(1, "http://good.com/", link("friend.org", "friend.org", "other.org")), page(2, "http://farm.org/", link("spam.net", "friend.org") + '<a href=//spam.net/x>'),
        page(3, "http://spam.net/de/", link("farm.org") + '<a href="/local">'), page(4, "http://friend.org/", None), page(5, "http://other.org/", link("good.com")),
        page(6, "http://lonely.org/"), page(1, "http://good.com/", None),
    ]
    got = judge(spark, pages)
    edges = {("good.com", "friend.org"): 2, ("good.com", "other.org"): 1, ("farm.org", "spam.net"): 2, ("farm.org", "friend.org"): 1, ("spam.net", "farm.org"): 1, ("other.org", "good.com"): 1}
    hosts = ["good.com", "farm.org", "spam.net", "friend.org", "other.org", "lonely.org"]
    trust = rank(hosts, edges, ["good.com"])
    distrust = rank(hosts, {(b, a): c for (a, b), c in edges.items()}, ["spam.net"])
    for r in got.values():
        assert (r.trust, r.distrust) == (pytest.approx(trust[r.host]), pytest.approx(distrust[r.host]))
    assert {i: got[i].verdict for i in got} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def chain(spark, n, damping):
    link = lambda host: f'<a href="http://{host}/">z</a>'
    return judge(spark, [page(0, "http://spam.net/de/"), *(page(k, f"http://h{k}.org/", link(f"h{k - 1}.org" if k > 1 else "spam.net")) for k in range(1, n + 1))], damping=damping)


def test_hosts_far_from_a_seed_are_reached(spark):
    got = chain(spark, 13, 0.5)
    assert all(got[k].distrust > 0 and got[k].verdict == "block" for k in range(14))


def test_small_ranks_are_judged_by_their_share(spark):
    got = chain(spark, 1, 1e-13)
    assert 0 < got[1].distrust < 1e-12 and got[1].verdict == "block"


def test_empty_tables(spark):
    assert judge(spark, []) == {}
    df = spark.createDataFrame([page(1, "http://a.com/")], "page_id long, url string, html string, host string, verdict string")
    assert [r.verdict for r in U.judge_urls(df, U.rules_frame(spark).limit(0)).collect()] == ["allow"]


def test_query_equals_sql(spark):
    from scoreloom.llm.queries import QUERIES

    assert rows_of(QUERIES["op9_url_filter"](spark, SF)) == by_sql(U.ORACLE)
