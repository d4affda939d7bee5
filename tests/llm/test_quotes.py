"""Conversations of replies against brute force."""

import random

import pytest

from formloom.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """thread and position of each key: walk up to the opening, or to the first message of a circle."""
    up = {(r["conv_id"], r["turn"]): (r["parent_conv_id"], r["parent_turn"]) if r["parent_conv_id"] is not None else None for r in rows}
    cuts = set()
    for k in up:
        seen = []
        while k is not None and k not in seen:
            seen.append(k)
            k = up[k]
        if k is not None:
            cuts.add(min(seen[seen.index(k) :]))
    place = {}
    for k in up:
        at, depth = k, 0
        while at not in cuts and up[at] is not None:
            at, depth = up[at], depth + 1
        place[k] = (at, depth)
    threads = {}
    for k, (root, depth) in place.items():
        threads.setdefault(root, []).append((depth, k))
    return {k: (root, i) for root, found in threads.items() for i, (_, k) in enumerate(sorted(found))}


def told(df):
    rows = [r.asDict() for r in df.collect()]
    return rows, {(r["conv_id"], r["turn"]): ((r["thread_conv_id"], r["thread_turn"]), r["position"]) for r in rows}


def test_a_parent_in_a_later_conversation_comes_first(spark):
    rows = [(5, 0, "user", "> Only here said\n\nWhy?"), (5, 1, "assistant", "Because."), (9, 0, "user", "Only here said"), (9, 1, "user", "More."), (None, 1, "user", "x")]
    rows, got = told(quotes.linked_messages(spark.createDataFrame(rows, SCHEMA)))
    assert [k for k, v in sorted(got.items(), key=lambda x: x[1][1] if x[1][1] is not None else 99)] == [(9, 0), (5, 0), (9, 1), (5, 1), (None, 1)]
    assert {v[0] for k, v in got.items() if k[0]} == {(9, 0)} and got[None, 1] == ((None, None), None)


def test_a_circle_opens_at_its_first_message(spark):
    rows = [(1, 0, "u", "> said by two\n\nsaid by one"), (2, 0, "u", "> said by one\n\nsaid by two"), (2, 1, "u", "and on"), (3, 0, "u", "alone")]
    rows, got = told(quotes.linked_messages(spark.createDataFrame(rows, SCHEMA)))
    assert got == {(1, 0): ((1, 0), 0), (2, 0): ((1, 0), 1), (2, 1): ((1, 0), 2), (3, 0): ((3, 0), 0)}


@pytest.mark.parametrize("seed", range(2))
def test_conversations_agree_with_brute_force(spark, seed):
    rng = random.Random(seed)
    keys = [(c, t) for c in range(25) for t in range(rng.choice([1, 3, 40])) if rng.random() > 0.05]
    rows = []
    for c, t in keys:
        quote = [f"> said {a} {b}" for a, b in [rng.choice(keys)] if rng.random() < 0.2] + ["> said 0 0"] * (rng.random() < 0.1)
        rows.append((c, t, "user", "\n\n".join([*quote, f"said {c} {t}"])))
    rows, got = told(quotes.linked_messages(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert len(rows) == len(keys) and got == brute(rows) and any(r["linked"] for r in rows)


def test_repeated_messages_have_places_of_their_own(spark):
    rows = [(1, 0, "u", "same"), (1, 0, "u", "same"), (1, 1, "u", "next"), (1, 1, "u", "other")]
    rows, _ = told(quotes.linked_messages(spark.createDataFrame(rows, SCHEMA)))
    assert sorted((r["turn"], r["position"], r["thread_turn"]) for r in rows) == [(0, 0, 0), (0, 1, 0), (1, 2, 0), (1, 3, 0)]


def brute_links(rows):
    """n_linked and parent of each key, by looking through all messages."""
    wrote = {}
    for c, t, _, text in rows:
        for level, passage in quotes.passages(text or ""):
            if not level:
                for part in {passage, *passage.split("\n")}:
                    if n := quotes.normalised_passage(part):
                        wrote.setdefault(n, set()).add((c, t))
    out = {}
    for c, t, _, text in rows:
        best, n = None, 0
        for at, (level, passage) in enumerate(quotes.passages(text or "")):
            if level:
                all_ = wrote.get(quotes.normalised_passage(passage), set())
                own = [k for k in all_ if k[0] == c and k[1] < t]
                found = min(own or [k for k in all_ if k[0] != c], default=None)
                if found:
                    n += 1
                    best = max(best or (-99, 0, None), (-level, at, found))
        before = max((b for a, b, *_ in rows if a == c and b < t), default=None)
        out[c, t] = (n, best[2] if best else (c, before) if before is not None else (None, None))
    return out


def test_links_agree_with_brute_force(spark):
    """Gaps in turns, passages written in several conversations, circles, lines out of runs, empty and very long texts, clashing columns."""
    rng = random.Random(7)
    rows = [
        (1, 0, "u", "> Hello world"), (1, 2, "u", "Hello world"), (2, 0, "u", "Hello world\nand a second line"), (3, 5, "u", "> and a SECOND line"), (3, 9, "u", "> ...\n\nHello world"), (4, 1, "u", None),
        (4, 7, "u", ""), (4, 4000, "u", "after a gap"), (4, 2_000_000, "u", ">> and a second line\n> after a gap"), (5, 0, "u", " ".join(f"word{i}" for i in range(60_000))), (6, 0, "u", "> " + " ".join(f"Word{i}," for i in range(60_000))),
        (7, 0, "u", "> nobody wrote this"), (8, 0, "u", "> > deep\n> less deep\nflat"), (8, 1, "u", "deep"), (9, 3, "u", "less deep"),
    ]
    rows += [(20 + c, t, "u", "\n".join([f"> said {rng.randint(0, 12)}"] * (rng.random() < 0.6) + ["", f"said {rng.randint(0, 12)}", f"said {rng.randint(0, 40)}"])) for c in range(12) for t in rng.sample(range(3000), 9)]
    got = quotes.linked_messages(spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", hash string, position int").repartition(4)).collect()
    assert {(r["conv_id"], r["turn"]): (r["n_linked"], (r["parent_conv_id"], r["parent_turn"])) for r in got} == brute_links(rows) and len(got) == len(rows)
    clean = {(r["conv_id"], r["turn"]): r["clean_text"] for r in got}
    assert clean[4, 1] == clean[4, 7] == clean[1, 0] == "" and clean[8, 0] == "flat"


def test_previous_turns_across_runs(spark):
    turns = [(c, t) for c in (1, 2) for t in (0, 1, 1023, 1024, 5000, 5001, 9_000_000)] + [(3, -5), (3, 7)]
    got = {(r["conv_id"], r["turn"]): r["before"] for r in quotes.previous_turns(spark.createDataFrame(turns, "conv_id long, turn long")).collect()}
    assert got == {(c, t): max((u for d, u in turns if d == c and u < t), default=None) for c, t in turns}


def test_many_replies_to_one_message(spark, monkeypatch):
    from formloom.llm import session

    monkeypatch.setattr(session, "HOT_ROWS", 8)
    rows = [(0, 0, "u", "the source")] + [(c, 0, "u", f"> the source\n\nreply {c}") for c in range(1, 120)] + [(c, 0, "u", f"> reply {c - 200}") for c in range(201, 230)]
    rows_, got = told(quotes.linked_messages(spark.createDataFrame(rows, SCHEMA).repartition(6)))
    assert got == brute(rows_) and {v[0] for v in got.values()} == {(0, 0)} and len(got) == len(rows)
