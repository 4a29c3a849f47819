"""Publishing runs against the same flow written as plain loops, and tables that become visible together."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dispatchery import constants as K
from dispatchery.operators import publication, quality
from dispatchery.sources.publications import Publications

NOW = dt.datetime(2024, 3, 1)
MODELS = list(K.PRICES)
DAYS = ["2024-01-01", "2024-01-02"]
# id, day, title, summary, why, tags, key fact
SUMMARIES = [
    (i, DAYS[i % 2], f"Title number{i}", f"Summary about thing{i}" + (" costs 777 million" if i % 3 == 0 else ""),
     "" if i == 8 else "because " * (30 if i % 4 == 0 else 3), f'["tag{i % 3}", "shared"]', f"thing{i}" if i % 2 else "absentword")
    for i in range(1, 13)
]
STORED = [(5, DAYS[0], "en", 1), (9, DAYS[0], "en", 2)]
# run: day, picks, note, note_tr
RUNS = {
    101: (DAYS[0], [2, 4, 6], " note ", "not"),
    102: (DAYS[1], [1, 3], "note", "not"),
    103: (DAYS[0], [10, 12, 2], "note", "not"),      # a second version of the same day
    104: (DAYS[0], [8], "note", "not"),              # blank prose
    105: (DAYS[1], [5, 7], "note", " "),             # note not translated
    106: (DAYS[1], [11], "note", "not"),             # no valid translation
    107: (DAYS[1], [], "note", "not"),               # ranked nothing: only its row is closed
    108: (DAYS[1], [9], "note", "not"),              # a translated reason without a reason
}
RANKED = [
    (run, s, place, "lead" if place == 1 else "brief", "" if s % 4 == 2 else f" why {s} ",
     ("stray" if run == 108 else None) if s % 4 == 2 or run == 108 else f"TR {s}")
    for run, (_, picks, _, _) in RUNS.items() for place, s in enumerate(picks, 1)]
RANKED = [r if r[0] != 108 else (*r[:4], " ", "stray") for r in RANKED]
HEADS = [(run, day, "en", note, tr, 0.5, MODELS[1]) for run, (day, _, note, tr) in RUNS.items()]
PAYLOADS = [(run, s, seq, MODELS[s % 2], 100 * s + seq, 10) for run in RUNS for s in (run % 5 + 1, run % 5 + 2) for seq in (1, 2) if run != 107]
FAILURES = [(101, MODELS[0], 50, 0), (106, MODELS[0], 70, 1)]
CALLS = [(101, "rank", MODELS[1], 1000, 100), (101, "translate", MODELS[0], 300, 30), (103, "rank", MODELS[1], 500, 50)]
ERRORS = [(101, n, f"error {n:02d}") for n in range(25)] + [(102, 1, "")]


def price(model, tokens_in, tokens_out):
    pair = next((v for k, v in K.PRICES.items() if model.startswith(k)), K.DEAREST_PRICE)
    return (tokens_in * pair[0] + tokens_out * pair[1]) / 1e6


def by_hand(done=(), stored=STORED):
    """(bulletins, items, checks, figures, run rows, gaps) as sets of plain tuples."""
    prose = {s[0]: s for s in SUMMARIES}
    bulletins, items, checks, figures, runs, gaps = {}, set(), {}, set(), {}, set()
    accepted = []
    for run, (day, picks, note, note_tr) in RUNS.items():
        if run in done:
            continue
        mine = [r for r in RANKED if r[0] == run]
        found = set()
        for _, s, _, _, reason, reason_tr in mine:
            if not prose[s][4].strip():
                found.add((run, s, "blank prose"))
            elif s == 11:
                found.add((run, s, "no valid translation"))
            elif reason.strip() and not (reason_tr or "").strip():
                found.add((run, s, "reason not translated"))
            elif not reason.strip() and (reason_tr or "").strip():
                found.add((run, s, "translated reason of none"))
        if picks and not note_tr.strip():
            found.add((run, None, "editor note not translated"))
        gaps |= found
        if found:
            continue
        accepted.append((day, run))
        paid = {}
        for r, s, seq, model, tokens_in, tokens_out in PAYLOADS:
            if r == run and seq >= paid.get(s, (0,))[0]:
                paid[s] = (seq, model, tokens_in, tokens_out)
        charges = [p[1:] for p in paid.values()] + [f[1:] for f in FAILURES if f[0] == run] + [c[2:] for c in CALLS if c[0] == run]
        errors = [e for r, _, e in ERRORS if r == run]
        runs[run] = (len(paid), sum(c[1] for c in charges), sum(c[2] for c in charges), round(sum(price(*c) for c in charges), 9),
                     "\n".join(errors[:20]) or None, "partial" if errors else "ok")
    next_id = max([b[0] for b in stored], default=0)
    for day, run in sorted(accepted):
        picks = RUNS[run][1]
        if not picks:
            continue
        next_id += 1
        version = max([b[3] for b in stored if b[1] == day], default=0) + 1 + sum(1 for b in bulletins.values() if b[0] == day)
        bulletins[next_id] = (day, version, run, RUNS[run][2].strip(), round(sum(price(*c[2:]) for c in CALLS if c[0] == run and c[1] == "rank"), 9))
        items |= {(next_id, s, place, tier, reason.strip() or None, (tr or "").strip() or None)
                  for r, s, place, tier, reason, tr in RANKED if r == run}
        shown = [s for s in SUMMARIES if s[1] == day or s[0] in picks]
        odd = [s[0] for s in shown if s[0] % 3 == 0]
        tags = [t for s in shown for t in (f"tag{s[0] % 3}", "shared")]
        checks[next_id] = (len(shown), len(picks), sum(1 for s in shown if len(s[4].split()) > 20), len(odd),
                           round(sum(1 for s in shown if s[0] % 2) / len(shown), 9), len(set(tags)))
        figures |= {(next_id, s, ("777000000",)) for s in odd}
    return bulletins, items, checks, figures, runs, gaps


@pytest.fixture(scope="module")
def given(spark):
    frame = spark.createDataFrame
    summaries = frame([(i, i, "en", day, t, s, w, tags, fact) for i, day, t, s, w, tags, fact in SUMMARIES],
                      "id bigint, article_id bigint, language string, day string, title_local string, summary string,"
                      " why_it_matters string, tags_json string, key_fact string")
    articles = frame([(s[0], "t", "feed", "A body of 42 million words") for s in SUMMARIES],
                     "id bigint, title string, body_source string, body_text string")
    return {
        "runs": frame([(r, 7, 3) for r in RUNS], "run_id bigint, n_collected bigint, n_new bigint"),
        "ranked": frame(RANKED, "run_id bigint, summary_id bigint, position int, tier string, reason string, reason_tr string"),
        "heads": frame(HEADS, "run_id bigint, day string, language string, editor_note string, editor_note_tr string, agreement double, model_rank string"),
        "summaries": summaries, "valid": summaries.where("id <> 11").select("id"), "facts": quality.body_facts(articles),
        "payloads": frame(PAYLOADS, "run_id bigint, summary_id bigint, seq int, model string, tokens_in bigint, tokens_out bigint"),
        "failures": frame(FAILURES, "run_id bigint, model string, tokens_in bigint, tokens_out bigint"),
        "calls": frame(CALLS, "run_id bigint, node string, model string, tokens_in bigint, tokens_out bigint"),
        "errors": frame(ERRORS, "run_id bigint, seq int, error string"),
    }


def held(spark, done=()):
    return {"bulletins": spark.createDataFrame(STORED, "id bigint, day string, language string, version int"),
            "runs": spark.createDataFrame([(r,) for r in done], "run_id bigint")}


def as_plain(tables, gaps):
    rows = {name: df.collect() for name, df in tables.items()}
    bulletins = {r["id"]: (r["day"], r["version"], r["run_id"], r["editor_note"], round(r["est_cost_usd"], 9)) for r in rows["bulletins"]}
    items = {tuple(r[c] for c in ("bulletin_id", "summary_id", "position", "tier", "reason", "reason_tr")) for r in rows["items"]}
    checks = {}
    for r in rows["checks"]:
        c = r["checks"]
        kept = c["content"]["key_fact_kept"]
        checks[r["bulletin_id"]] = (c["n"], c["n_published"], c["budget"]["why_it_matters_over"], c["ungrounded"], round(kept, 9), c["tags"]["distinct"])
    figures = {(r["bulletin_id"], r["article_id"], tuple(r["numerals"])) for r in rows["figures"]}
    runs = {r["run_id"]: (r["n_summarized"], r["tokens_in"], r["tokens_out"], round(r["est_cost_usd"], 9), r["error"], r["status"]) for r in rows["runs"]}
    return bulletins, items, checks, figures, runs, {tuple(r) for r in gaps.select("run_id", "summary_id", "gap").collect()}


def test_runs_publish_as_plain_loops_do(spark, given):
    got = as_plain(*publication.prepare(held(spark), **given, now=F.lit(NOW)))
    assert got == by_hand()
    assert {b[2] for b in got[0].values()} == {101, 102, 103} and set(got[4]) == {101, 102, 103, 107}


def test_a_stored_run_is_left_alone(spark, given):
    got = as_plain(*publication.prepare(held(spark, (101, 107)), **given, now=F.lit(NOW)))
    assert got == by_hand(done=(101, 107))


def test_nothing_to_publish(spark, given):
    none = {name: df.where("false") if name not in ("summaries", "facts", "valid") else df for name, df in given.items()}
    tables, gaps = publication.prepare(held(spark), **none, now=F.lit(NOW))
    assert all(df.isEmpty() for df in tables.values()) and gaps.isEmpty()


def test_a_second_commit_changes_nothing(spark, given, tmp_path):
    shelf = Publications(spark, str(tmp_path / "press"))
    tables, gaps = publication.prepare(held(spark), **given, now=F.lit(NOW))
    schemas = {name: df.schema for name, df in tables.items()}
    assert shelf.commit("a", tables)
    read = lambda: as_plain({name: shelf.read(name, schemas[name]) for name in tables}, gaps)
    assert read() == by_hand()
    assert not shelf.commit("a", tables)
    stored = {"bulletins": shelf.read("bulletins", schemas["bulletins"]), "runs": shelf.read("runs", schemas["runs"])}
    again, _ = publication.prepare(stored, **given, now=F.lit(NOW))
    assert shelf.commit("b", again)
    assert read() == by_hand()


def test_a_lost_batch_shows_nothing_and_runs_again(spark, tmp_path):
    shelf = Publications(spark, str(tmp_path / "lost"))
    good = spark.range(3)
    broken = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception):
        shelf.commit("x", {"one": good, "two": broken})
    assert shelf.read("one", good.schema).isEmpty()
    assert shelf.commit("x", {"one": spark.range(5), "two": good})
    assert shelf.read("one", good.schema).count() == 5 and shelf.read("two", good.schema).count() == 3


def test_a_measurement_that_fails_loses_no_bulletin(spark, tmp_path):
    shelf = Publications(spark, str(tmp_path / "measured"))
    good = spark.range(3)
    broken = good.select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    assert shelf.commit("x", {"bulletins": good, "checks": broken}, optional=("checks",))
    assert shelf.read("bulletins", good.schema).count() == 3 and shelf.read("checks", good.schema).isEmpty()
