"""Block-list lines and a large rule table against every rule tried on every URL."""

import random
import re

from sensorweave.llm import urls
from sensorweave.llm.queries import URL_LINES, URL_RULES


def brute(rules, host, path):
    fit = [r for r in rules if re.search(r.pattern, host + path)]
    return max(fit, key=lambda r: (r.rank, len(r.name), r.name), default=None)


def judged(spark, rules, given):
    df = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    return {r.page_id: r for r in urls.judge(df, rules).collect()}


def test_lines_become_rules():
    lines = ["! note", "[Adblock]", "", "||ads.example^", "@@||ads.example/ok", "/banner/*/img", "|http://start.", "swf|", "x##.ad",
             "||a.example^$script", "**", r"/[a-z]{3}\d+\.html/"]
    rules, left_out = urls.filter_rules(lines, rank=3)
    assert left_out == ["x##.ad", "||a.example^$script", "**"]
    got = {r.name: r for r in rules}
    assert set(got) == {"||ads.example^", "@@||ads.example/ok", "/banner/*/img", "|http://start.", "swf|", r"/[a-z]{3}\d+\.html/"}
    assert got["||ads.example^"].tokens == ("ads", "example") and got["@@||ads.example/ok"].tokens == ("ads", "example")
    assert got["/banner/*/img"].tokens == ("banner",) and got["|http://start."].tokens == ("start",) and got["swf|"].tokens == ()
    assert got["@@||ads.example/ok"].rank == 4 and got["@@||ads.example/ok"].verdict == "allow" and got["||ads.example^"].rank == 3
    assert re.search(got["||ads.example^"].pattern, "x.ads.example/") and not re.search(got["||ads.example^"].pattern, "bads.example/")
    assert not re.search(got["||ads.example^"].pattern, "ads.example.org/")


def test_large_table_equals_every_rule_on_every_url(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ad", "tra", "shop", "new", "blo", "x", "Q") for b in ("s", "ck", "1", "22", "king", "")]

    def piece():
        return "".join(rng.choice(words) + rng.choice([".", "-", "/", "_"]) for _ in range(rng.randrange(1, 4)))

    lines = []
    for i in range(3000):
        body = piece().rstrip("./-_") + (str(i) if i % 3 else "")
        lines.append(rng.choice(["||", "||", "|", "", "@@||", "@@"]) + body + rng.choice(["", "^", "*", "/*/z", "|", "^*-"]))
    rules, _ = urls.filter_rules(lines)
    given = [f"http://{piece().strip('./-_').replace('/', '.')}{rng.choice(['', str(rng.randrange(3000))])}.example/{piece()}{rng.choice(['', 'z', '?' + piece()])}" for _ in range(150)]
    given += [given[0], None, "", "no scheme", "http://" + "ads." * 5000 + "example/"]
    got = judged(spark, rules, given)
    hits = 0
    for i, url in enumerate(given):
        want = brute(rules, got[i].host, got[i].path)
        assert (got[i].rule, got[i].verdict) == ((want.name, want.verdict) if want else (None, "allow")), url
        hits += want is not None
    assert len(got) == len(given) and hits > 50


def test_rules_of_the_query(spark):
    assert not urls.filter_rules(URL_LINES)[1]
    given = ["http://m.casino-win.example.com/en/1", "https://free-bets.example.com/es/2", "http://m.ads-track.example.com/fr/3", "http://a.example.com/en/x-track.gif",
             "http://m.casino-win.example.net/en/1", "http://x.example.com/ads.txt", "http://loads.example.com/en/tracks/1", "http://www.example.com/en/CASINO/1",
             "http://responsible-gambling.example.com/casino/", "http://free-bets.example.org/fr/1"]
    got = judged(spark, URL_RULES, given)
    assert [got[i].verdict for i in range(len(given))] == ["block", "block", "block", "block", "allow", "allow", "allow", "block", "allow", "allow"]
