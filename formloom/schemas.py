"""Schemas of evidence tables. Every table is keyed by job and page; ``seq`` is the order within a job."""

SPANS = "job_id string, page int, seq long, id string, text string, confidence double, x1 int, y1 int, x2 int, y2 int, script string, source string, attempt int"
BLOCKS = "job_id string, page int, seq long, id string, label string, content string, confidence double, x1 int, y1 int, x2 int, y2 int, `order` int, source string"
CONTROLS = "job_id string, page int, seq long, id string, kind string, state string, state_confidence double, x1 int, y1 int, x2 int, y2 int, ink_ratio double, associated_label_id string, source string, attempt int"
PROPOSALS = "job_id string, pid long, path string, raw string, evidence_ids array<string>"
CORRECTIONS = "job_id string, path string, value string"
#: A job's name may also be a folder's name.
JOB_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
