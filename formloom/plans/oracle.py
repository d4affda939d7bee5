"""The catalogue's queries again, as DuckDB SQL over the same tables.

Named steps build on each other; ``sql(step, select)`` strings together those that a step needs.
"""

from __future__ import annotations

import re

from .blueprint import Blueprint
from .forms import BLOCKS, BLUEPRINT, CONTROLS, SPANS, portable

_BP = Blueprint.from_dict(BLUEPRINT)


def canon(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


_PATHS = [(p, i, s.type, p in _BP.critical_paths, False) for i, (p, s) in enumerate(_BP.fields.items())]
_PATHS += [(o.output_path, len(_PATHS) + i, "boolean", False, True) for i, (_, _, o) in enumerate(_BP.options())]
_ALIASES = [(p, a, "field") for p, s in _BP.fields.items() for a in s.aliases] + [(o.output_path, a, "option") for _, _, o in _BP.options() for a in o.aliases]

_AREA = lambda a, b: f"(greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0) * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0))"
_CX, _CY = (lambda a: f"(({a}x1 + {a}x2) / 2.0::DOUBLE)"), (lambda a: f"(({a}y1 + {a}y2) / 2.0::DOUBLE)")
_COALESCE_KG = "regexp_replace(regexp_replace(printf('%.3f', {g} / 1000.0::DOUBLE), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"

STEPS: dict[str, str] = {
    "spans": portable(SPANS), "controls": portable(CONTROLS), "blocks": portable(BLOCKS),
    "paths": _values(_PATHS, "path, ord, type, critical, checkbox"), "al": _values(_ALIASES, "path, alias, kind"),
    "texts": f"SELECT DISTINCT {canon('text')} AS canon FROM spans",
    "sc": f"""SELECT canon, path, kind, max(score) AS score FROM (SELECT canon, path, kind, CASE WHEN canon = t THEN 1.0::DOUBLE WHEN contains(canon, t) THEN least(0.98::DOUBLE, length(t) / greatest(length(canon), 1)::DOUBLE + 0.35::DOUBLE) END AS score
        FROM texts, (SELECT path, kind, {canon('alias')} AS t FROM al)) WHERE score IS NOT NULL GROUP BY ALL""",
    "lh": f"SELECT s.*, sc.path, sc.score AS match FROM spans s JOIN sc ON {canon('s.text')} = sc.canon WHERE sc.kind = 'field' AND sc.score >= 0.78",
    "pairs": """SELECT l.job_id, l.page, l.path, l.match, l.seq AS l_seq, l.id AS l_id, l.confidence AS l_confidence, l.source AS l_source, l.x1 AS lx1, l.y1 AS ly1, l.x2 AS lx2, l.y2 AS ly2,
        v.seq AS v_seq, v.id AS v_id, v.text AS v_text, v.confidence AS v_confidence, v.source AS v_source, v.x1 AS vx1, v.y1 AS vy1, v.x2 AS vx2, v.y2 AS vy2
        FROM lh l JOIN spans v ON l.job_id = v.job_id AND l.page = v.page AND l.id <> v.id""",
    "nright": f"""SELECT *, 'right_of_label' AS strategy, 1.0 / (1.0 + (vx1 - lx2) / greatest(ly2 - ly1, 1)::DOUBLE / 8.0) AS geometry FROM pairs
        WHERE abs({_CY('l')} - {_CY('v')}) <= 0.80::DOUBLE * greatest(ly2 - ly1, vy2 - vy1) AND vx1 - lx2 >= -0.05::DOUBLE * (lx2 - lx1) AND (vx1 - lx2) / greatest(ly2 - ly1, 1)::DOUBLE <= 24""",
    "nbelow": """SELECT *, 'below_label' AS strategy, 0.86::DOUBLE / (1.0 + (vy1 - ly2) / greatest(5.0::DOUBLE * (ly2 - ly1), 1)) AS geometry FROM pairs
        WHERE vy1 - ly2 >= -0.05::DOUBLE * (ly2 - ly1) AND vy1 - ly2 <= 4.0 * (ly2 - ly1) AND greatest(0, least(lx2, vx2) - greatest(lx1, vx1)) / greatest(least(lx2 - lx1, vx2 - vx1), 1)::DOUBLE >= 0.20::DOUBLE""",
    "nb": "SELECT * FROM nright UNION ALL SELECT * FROM nbelow",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY job_id, path, l_seq ORDER BY geometry DESC, v_seq, strategy DESC) AS rank, max(geometry) OVER (PARTITION BY job_id, path, l_seq) AS best FROM nb",
    "top": "SELECT * FROM ranked WHERE rank <= CASE WHEN best >= 0.78 THEN 1 ELSE 2 END",
    "ct0": f"""SELECT t.job_id, t.path, p.ord, p.type, t.l_seq, t.rank, trim(regexp_replace(t.v_text, '\\s+', ' ', 'g')) AS raw, [t.l_id, t.v_id] AS ev, 'rule_' || t.strategy AS source,
        CASE WHEN t.l_source = t.v_source THEN [t.l_source] ELSE [t.l_source, t.v_source] END AS sources, least(t.l_confidence, t.v_confidence) AS recognition, greatest(0.0::DOUBLE, least(1.0::DOUBLE, t.match * t.geometry)) AS association
        FROM top t JOIN paths p USING (path) WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.canon = {canon('t.v_text')} AND sc.kind = 'field' AND sc.score >= 0.93)""",
    "ct": f"""SELECT *, CASE type WHEN 'string' THEN raw WHEN 'weight' THEN CASE WHEN regexp_full_match(raw, '\\d+ g') THEN {_COALESCE_KG.format(g="CAST(regexp_extract(raw, '\\d+') AS DOUBLE)")} || ' kg' END
        ELSE CASE WHEN regexp_full_match(raw, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN raw WHEN regexp_full_match(raw, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN strftime(try_strptime(raw, '%d/%m/%Y'), '%Y-%m-%d') WHEN regexp_full_match(raw, '\\d{{8}}') THEN strftime(try_strptime(raw, '%d%m%Y'), '%Y-%m-%d') END END AS value,
        CASE type WHEN 'weight' THEN 'invalid_weight' ELSE 'invalid_date' END AS bad FROM ct0""",
    "near": f"""SELECT c.job_id, c.id AS c_id, s.id AS s_id, row_number() OVER (PARTITION BY c.job_id, c.id ORDER BY greatest(0, s.x1 - c.x2) + 2.0 * abs({_CY('c.')} - {_CY('s.')}), s.seq) AS r
        FROM controls c JOIN spans s ON c.job_id = s.job_id AND c.page = s.page WHERE abs({_CY('c.')} - {_CY('s.')}) <= greatest(c.y2 - c.y1, s.y2 - s.y1) AND s.x1 - c.x2 >= -0.25::DOUBLE * (c.x2 - c.x1) AND s.x1 - c.x2 <= 16 * (c.x2 - c.x1)""",
    "assoc": "SELECT c.*, n.s_id AS label_id FROM controls c LEFT JOIN near n ON c.job_id = n.job_id AND c.id = n.c_id AND n.r = 1",
    "cb": f"""SELECT a.job_id, sc.path, p.ord, 'boolean' AS type, a.seq AS l_seq, 0::BIGINT AS rank, CASE a.state WHEN 'checked' THEN 'true' WHEN 'unchecked' THEN 'false' END AS raw, [a.id, a.label_id] AS ev, 'opencv_control' AS source, ['opencv'] AS sources,
        a.state_confidence AS recognition, sc.score AS association, raw AS value, 'ambiguous_control_state' AS bad
        FROM assoc a JOIN spans s ON a.job_id = s.job_id AND a.label_id = s.id JOIN sc ON sc.canon = {canon('s.text')} AND sc.kind = 'option' AND sc.score >= 0.76 JOIN paths p ON p.path = sc.path""",
    "cand": "SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY type = 'boolean', ord, l_seq, rank) - 1 AS seq FROM (SELECT * FROM ct UNION ALL SELECT * FROM cb)",
    "v1": """SELECT *, CASE WHEN value IS NULL THEN [bad, 'normalization_failed'] WHEN type = 'weight' AND NOT (CAST(regexp_extract(value, '[0-9.]+') AS DOUBLE) BETWEEN 0.3 AND 8.0) THEN ['birth_weight_out_of_range'] ELSE []::VARCHAR[] END AS codes0 FROM cand""",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, path ORDER BY recognition * association DESC, seq) AS r FROM v1) WHERE r = 1",
    "extra": """SELECT c.job_id, c.seq, 'collection_before_birth' AS code FROM best c JOIN best b ON c.job_id = b.job_id WHERE c.path = 'data.baby.sample.collection.date' AND b.path = 'data.baby.dateOfBirth' AND c.value < b.value
        UNION ALL SELECT x.job_id, unnest([x.seq, y.seq]), 'exclusive_group_conflict' FROM best x JOIN best y ON x.job_id = y.job_id WHERE x.path = 'data.baby.male' AND y.path = 'data.baby.female' AND x.value = 'true' AND y.value = 'true'""",
    "more": "SELECT job_id, seq, list(DISTINCT code ORDER BY code) AS codes1 FROM extra GROUP BY job_id, seq",
    "vc": "SELECT v.*, list_concat(codes0, coalesce(codes1, [])) AS codes FROM v1 v LEFT JOIN more m ON m.job_id = v.job_id AND m.seq = v.seq",
    "usable": "SELECT * FROM vc WHERE value IS NOT NULL",
    "cl": """SELECT job_id, path, value, max(recognition * association) AS strength, min(seq) AS first, count(*) AS votes, max(recognition) AS recognition, max(association) AS association, list_distinct(flatten(list(codes))) AS codes,
        list_distinct(flatten(list(sources))) AS sources, len(list_distinct(flatten(list(sources)))) AS n_sources FROM usable GROUP BY job_id, path, value""",
    "win": "SELECT *, count(*) OVER (PARTITION BY job_id, path) AS clusters, sum(votes) OVER (PARTITION BY job_id, path) AS all_votes, row_number() OVER (PARTITION BY job_id, path ORDER BY n_sources DESC, strength DESC, first) AS r FROM cl",
    "jobs": "SELECT DISTINCT job_id FROM spans",
    "d0": """SELECT j.job_id, p.path, p.ord, p.critical, w.value, w.n_sources, w.clusters > 1 AS conflict, w.votes / greatest(w.all_votes, 1)::DOUBLE AS agreement, w.recognition, w.association,
        list_sort(list_filter(w.codes, lambda c: regexp_matches(c, '^(invalid_|ambiguous_|normalization_failed|pattern_mismatch|birth_weight_out_of_range|collection_before_birth|exclusive_group_conflict)'))) AS fatal
        FROM jobs j CROSS JOIN paths p LEFT JOIN win w ON w.job_id = j.job_id AND w.path = p.path AND w.r = 1""",
    "d1": """SELECT *, exp(0.14 * ln(0.95::DOUBLE) + 0.24 * ln(greatest(0.01, recognition)) + 0.20 * ln(greatest(0.01, association)) + 0.16 * ln(greatest(0.01, agreement)) + 0.16 * ln(CASE WHEN len(fatal) > 0 THEN 0.25 ELSE 1.0 END) + 0.10 * ln(1.0)) AS s FROM d0""",
    "d2": """SELECT *, CASE WHEN value IS NULL THEN 0.0 ELSE round(greatest(0.0, least(1.0, s, CASE WHEN len(fatal) > 0 THEN 0.49 ELSE 1 END, CASE WHEN conflict THEN 0.59 ELSE 1 END, CASE WHEN n_sources < 2 THEN 0.89 ELSE 1 END)), 6) END AS score FROM d1""",
    "dec": """SELECT *, CASE WHEN value IS NULL THEN CASE WHEN critical THEN 'review' ELSE 'missing' END WHEN score >= 0.90 THEN 'accepted' ELSE 'review' END AS disposition,
        CASE WHEN value IS NULL THEN ['no_grounded_candidate'] ELSE list_concat(list_concat(fatal, CASE WHEN conflict THEN ['source_conflict'] ELSE [] END), CASE WHEN n_sources < 2 THEN ['single_source_cap'] ELSE [] END) END AS reasons FROM d2""",
    "elig": "SELECT *, rank - 1 AS index FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY page, coalesce(\"order\", 1000000), y1, x1, id) AS rank FROM blocks WHERE label NOT IN ('image', 'header_image', 'figure', 'seal', 'stamp')) WHERE rank <= 24",
    "memb": f"SELECT s.job_id, s.page, s.id AS item_id, b.id AS block_id FROM spans s JOIN blocks b ON s.job_id = b.job_id AND s.page = b.page WHERE ({_CX('s.')} BETWEEN b.x1 AND b.x2 AND {_CY('s.')} BETWEEN b.y1 AND b.y2) OR {_AREA('s.', 'b.')} / greatest((s.x2 - s.x1) * (s.y2 - s.y1), 1)::DOUBLE >= 0.35",
    "bb0": f"""SELECT s.job_id, s.page, s.id, b.id AS block_id, {_AREA('s.', 'b.')} / greatest((s.x2 - s.x1) * (s.y2 - s.y1), 1)::DOUBLE AS coverage, ({_CX('s.')} BETWEEN b.x1 AND b.x2 AND {_CY('s.')} BETWEEN b.y1 AND b.y2) AS inside,
        (s.x2 - s.x1) * (s.y2 - s.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ba, b.index FROM spans s JOIN elig b ON s.job_id = b.job_id AND s.page = b.page""",
    "bb": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page, id ORDER BY coverage + CASE WHEN inside THEN 0.25 ELSE 0 END DESC, ba, index) AS r FROM bb0 WHERE coverage > 0 AND (coverage >= 0.35 OR (inside AND sa <= 4 * ba))) WHERE r = 1",
    "frag": """SELECT job_id, page, start, unnest([{length: 1, fragment: t0}, {length: 2, fragment: t0 || ' ' || t1}, {length: 3, fragment: t0 || ' ' || t1 || ' ' || t2}, {length: 4, fragment: t0 || ' ' || t1 || ' ' || t2 || ' ' || t3}], recursive := true) FROM (
        SELECT job_id, page, row_number() OVER w AS start, text AS t0, lead(text, 1) OVER w AS t1, lead(text, 2) OVER w AS t2, lead(text, 3) OVER w AS t3 FROM spans WINDOW w AS (PARTITION BY job_id, page ORDER BY y1, x1, id))""",
    "led": """SELECT job_id, id, 'ocr_span' AS kind, page, confidence, source, sha256(text) AS text_sha256 FROM spans UNION ALL SELECT job_id, id, 'layout_block', page, confidence, source, sha256(content) FROM blocks UNION ALL SELECT job_id, id, 'control', page, state_confidence, source, NULL FROM controls""",
}


def ratio(pairs: str) -> dict[str, str]:
    """Steps for the similarity ratio of ``pairs``, a select of distinct n, t: ``rt`` has n, t, ratio.

    The longest common part, the first in n and then in t, matches; so do those of what stands before and after it in both.
    """
    parts = "flatten(list_transform(range(1, length(b) + 1), lambda j: list_transform(range(1, length(b) - j + 2), lambda k: {k: k, i: -strpos(a, substr(b, j, k)), j: -j})))"
    return {
        "rp": pairs,
        "sm": f"""SELECT n, t, n AS a, t AS b, 0::BIGINT AS m FROM rp UNION ALL
            SELECT n, t, unnest([substr(a, 1, -x.i - 1), substr(a, -x.i + x.k)]), unnest([substr(b, 1, -x.j - 1), substr(b, -x.j + x.k)]), unnest([x.k, 0])
            FROM (SELECT n, t, a, b, list_reverse_sort(list_filter({parts}, lambda y: y.i < 0))[1] AS x FROM sm WHERE a <> '' AND b <> '') WHERE x IS NOT NULL""",
        "rt": "SELECT n, t, 2.0::DOUBLE * sum(m) / (length(n) + length(t)) AS ratio FROM sm GROUP BY n, t",
    }


def sql(select: str, steps: dict[str, str] | None = None) -> str:
    """``select`` with the steps that it names, and those they name, before it; ``steps`` are its own besides STEPS."""
    known = STEPS | (steps or {})
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"(FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                visit(known[name])

    visit(select)
    found = ",\n".join(f"{n} AS ({q})" for n, q in known.items() if n in needed)
    return f"WITH RECURSIVE {found}\n{select}" if found else select
