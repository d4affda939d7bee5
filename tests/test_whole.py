"""Registered queries do the whole job: small tables against brute force, where the SQL looks at a part."""

import re
from difflib import SequenceMatcher

from formloom.plans import catalogue
from formloom.plans.catalogue import _BP
from formloom.plans.forms import VALUES, form_table


def documents(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")


def test_value_part_reads_whole_texts(spark, tmp_path):
    texts = [None, "", " \t\n", "one", "a b", "x" * 300 + " tail", " " * 300 + "late\n\n word", "word " * 500 + "end", "line\r\none two " + "y" * 400]
    documents(spark, tmp_path, texts)
    got = {r["doc_id"]: (r["first_token"], r["remaining"]) for r in catalogue.QUERIES["value_part"](spark, str(tmp_path)).collect()}
    words = [(t or "").split() for t in texts]
    assert got == {i: (w[0] if w else None, " ".join(w[1:]) or None) for i, w in enumerate(words)}


def test_benchmark_support_compares_whole_passages(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(60))
    passages = [long, "Only three, words", "two words", "texts無空格", "ends in side", "", None, "one two three four five", "a b c d e f"]
    texts = [long, long[:200], f"x {long.upper()}, y", "only THREE words", "three words two words", "前texts無空格後", "bends in sidecars", None, "", "one two three four fivefold", "aa b c d e f", "one two three four"]
    documents(spark, tmp_path, texts)
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    canon = lambda t: re.sub(r"[\W]+", " ", (t or "").lower()).strip()
    want = {(i, j) for i, t in enumerate(texts) for j, p in enumerate(passages) if canon(p) and canon(p) in canon(t)}
    assert {(0, 0), (2, 0), (5, 3), (6, 4)} <= want and (1, 0) not in want
    assert sorted(map(tuple, catalogue.QUERIES["benchmark_support"](spark, str(tmp_path)).collect())) == sorted(want)


SF = "/root/testdata/sf0.001"
LABELS = ["Serial number", "First name", "Collection date", "Birth weight", "Date of birth"]


def few_forms(spark, folder):
    spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 12").write.parquet(f"{folder}/orders.parquet")
    spark.read.parquet(f"{SF}/customer.parquet").write.parquet(f"{folder}/customer.parquet")
    rows = form_table(spark, str(folder), VALUES).where("e = 0 and p = 'v'").collect()
    return {str(k): {r["i"]: r["val"] for r in rows if r["k"] == k} for k in {r["k"] for r in rows}}


def best_blocks(values, targets):
    """The four blocks whose label, value or both are most similar to one of the targets."""

    def score(n, t):
        if n == t:
            return 1.0
        return max(0.96, min(0.98, len(t) / len(n) + 0.35)) if t in n else SequenceMatcher(None, n, t).ratio()

    canon = lambda t: re.sub(r"[\W]+", " ", t.lower()).strip()
    texts = lambda i: map(canon, (LABELS[i], values[i], f"{LABELS[i]} {values[i]}"))
    return [f"b{i}" for i in sorted(range(5), key=lambda i: (-max(score(n, t) for n in texts(i) for t in targets), i))][:4]


def test_search_ranks_blocks_by_similarity(spark, tmp_path):
    forms = few_forms(spark, tmp_path)
    got = {}
    for r in catalogue.QUERIES["block_search_rank"](spark, str(tmp_path)).orderBy("job_id", "rank").collect():
        got.setdefault(r["job_id"], []).append(r["block_id"])
    assert got == {k: best_blocks(v, ["birth weight"]) for k, v in forms.items()} and any(v != ["b3", "b0", "b1", "b2"] for v in got.values())


def test_recovery_searches_blocks_by_similarity(spark, tmp_path):
    forms = few_forms(spark, tmp_path)
    aliases = {}
    for r in _BP.label_alias_rows(spark).collect():
        aliases.setdefault(r["path"], []).append(r["alias"])
    paths, blocks = {}, {}
    for r in catalogue.QUERIES["recovery_tasks"](spark, str(tmp_path)).collect():
        found = [p for p, how in zip(r["paths"].split(","), r["reasons"].split(","), strict=True) if how == "search"]
        if found:
            paths.setdefault(r["job_id"], set()).update(found)
            blocks.setdefault(r["job_id"], set()).add(r["block_id"])
    assert blocks and blocks == {k: set(best_blocks(forms[k], [a for p in v for a in aliases[p]])) for k, v in paths.items()}
    assert any(v != {"b0", "b1", "b2", "b3"} for v in blocks.values())


def test_small_crops_travel_together_and_large_ones_do_not():
    from formloom.sources import crops

    row = lambda data: ("j", "b", 1, *[0] * 9, data, [], None)
    assert [len(t) for t in crops.tables(iter([row(b"x" * 100)] * 999 + [row(None)] * 2))] == [crops.TABLE_ROWS, 1]
    assert [len(t) for t in crops.tables(iter([row(b"x" * crops.TABLE_BYTES)] * 3 + [row(b"")]))] == [1, 1, 1, 1]


def test_form_queries_store_no_spans_and_no_candidates(spark):
    """Forms are made again where they are read: the plan reaches the tables, and nothing but scores of labels is stored."""
    for df in (catalogue._candidates(spark, SF), catalogue._decisions(spark, SF)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        stored = [x for x in plan.splitlines() if "LogicalRDD" in x]
        assert "o_orderkey" in plan and not any("bbox" in x or "evidence_ids" in x or "x1" in x for x in stored)


def test_forms_are_dealt_once_for_all_readers(spark):
    """Every reader of the forms shares one exchange, and no row made of them is dealt again, though nothing is small enough to broadcast unasked."""
    import re

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = catalogue._decisions(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    lines = [re.sub(r"#\d+L?", "", re.sub(r"^[ :+\-|]*", "", x)) for x in plan.splitlines()]
    below = {lines[i + 1] for i, x in enumerate(lines) if "REPARTITION_BY_NUM" in x}
    assert len(below) == 1
    assert not [x for x in lines if "ENSURE_REQUIREMENTS" in x and "job_id" in x]


def test_labels_are_scored_without_dealing_forms(spark, monkeypatch):
    """Texts are scored where orders meet their customers; the forms are dealt once, for what reads them by job, and without a key that the job's name says."""
    from formloom.operators import mapping
    from formloom.plans import forms

    seen, scored = [], mapping.all_scores
    monkeypatch.setattr(mapping, "all_scores", lambda texts, *rest: seen.append(texts) or scored(texts, *rest))
    found = catalogue._decisions(spark, SF)
    assert [x for x in seen if "REPARTITION_BY_NUM" in x._jdf.queryExecution().executedPlan().toString()] == []
    of_spans = forms.form_jobs(spark, SF)[0].select("text").distinct()
    assert {r[0] for r in seen[0].select("text").distinct().collect()} == {r[0] for r in of_spans.collect()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(c_name" in plan and "struct(k" not in plan


def test_corrections_do_not_decide_again(spark):
    """The corrections of envelopes are made of the jobs: the plan normalises and decides candidates once, and deals the forms once."""
    plan = catalogue.QUERIES["envelope_fields"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    once = [x for x in plan.splitlines() if "Window [row_number()" in x and "norm_json" in x]
    assert len(once) == 1 and "ENSURE_REQUIREMENTS" not in "".join(x for x in plan.splitlines() if "job_id" in x)


def test_recovery_stores_no_forms_and_deals_no_texts(spark, tmp_path):
    """Forms, plans and blocks stay in their job's task: only the forms and the blocks' scores are dealt, and nothing with a box is stored."""
    few_forms(spark, tmp_path)
    execution = catalogue.QUERIES["recovery_tasks"](spark, str(tmp_path))._jdf.queryExecution()
    stored = [x for x in execution.optimizedPlan().toString().splitlines() if "LogicalRDD" in x]
    assert not any("x1" in x or "evidence_ids" in x for x in stored)
    assert not [x for x in execution.executedPlan().toString().splitlines() if "ENSURE_REQUIREMENTS" in x and "job_id" in x]


def test_texts_alike_to_labels_are_scored_once(spark):
    """Numbers and names that no label has reach the scorer as one text, whose scores are those of each."""
    from pyspark.sql import functions as F

    from formloom.operators import regions

    targets = (("birth weight",), ("sexo", "masculino"), ("x^-]y\\",))
    groups = (["sn 123", "sn 456", "sn 789"], ["customer 000000017", "customer 000000018"], ["birth weight 34 g", "birth weight 99 g"], ["sexo 1", "sexo 𝟚"], ["", "0", "ß0"], ["b1rth we1ght"], ["x^-]y\\ 1"])
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "i int, texts array<string>")
    scores = regions._text_scorer(targets, True)
    for i, sent in rows.select("i", regions.masked(F.col("texts"), targets)).collect():
        assert len(sent) == (3 if "" in groups[i] else 1)
        assert {scores(t) for t in groups[i]} == {scores(t) for t in sent}
    seen = spark.createDataFrame([(["sn 123", "sn 456"],)], "texts array<string>").select(regions.printed_label_scores(F.col("texts"), _BP.label_alias_rows(spark))[1])
    assert "regexp_replace" in seen._jdf.queryExecution().executedPlan().toString()


def test_engine_stores_no_forms(spark, tmp_path):
    """Evidence that is dealt by job is neither stored nor dealt again, and gives the decisions and candidates of stored evidence."""
    from formloom.plans import forms
    from formloom.plans.engine import Evidence, FormEngine

    few_forms(spark, tmp_path)
    spans, blocks, controls, jobs = forms.all_forms(spark, str(tmp_path))
    more = lambda rows: rows.selectExpr("*", "cast(null as string) as script", "0 as attempt")
    dealt = FormEngine(spark, _BP).extract(Evidence(more(spans), blocks, controls, jobs, forms.form_texts(spark, str(tmp_path))))
    execution = dealt.decisions._jdf.queryExecution()
    stored = [x for x in execution.optimizedPlan().toString().splitlines() if "LogicalRDD" in x]
    assert not any("x1" in x or "evidence_ids" in x for x in stored)
    assert not [x for x in execution.executedPlan().toString().splitlines() if "ENSURE_REQUIREMENTS" in x and "job_id" in x]
    spans, *rest = forms.staged_forms(spark, str(tmp_path))
    whole = FormEngine(spark, _BP).extract(Evidence(more(spans), *rest))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(dealt.decisions) == rows(whole.decisions) and dealt.decisions.count() > 0
    kept = [c for c in whole.candidates.columns if c != "attempt"]
    assert rows(dealt.candidates.select(kept)) == rows(whole.candidates.select(kept))
