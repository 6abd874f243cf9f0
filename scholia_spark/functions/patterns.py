"""Patterns of papers' plain text, used by the column functions and by the refinement inside tasks."""

#: The patterns that decide what refinement cuts, drops and keeps.
REFERENCES = r"(?im)^\s*(references|bibliography)\s*$"
PAGE_NUMBER = r"^\s*\d{1,4}\s*$"
COPYRIGHT = r"(?i)\b(copyright|\(c\)|©|all rights reserved)\b"
AUTHOR = r"(?i)^\s*(corresponding author|affiliation|e-?mail)\b"
RUNNING_HEAD = r"(?i)^\s*(preprint|under review|to appear in|arxiv:)\b"
#: Four numbers of up to three digits are an Internet address, unless all are below 20, and one of them below 10, as in a heading of
#: the fourth level.
ADDRESS = r"(?:(?:1\d\.){3}1\d|(?!(?:1?\d\.){3}1?\d\s)\d{1,3}(?:\.\d{1,3}){3})\s"
SECTION = rf"(?m)^\s*(?:(?!{ADDRESS})(?:\d{{1,4}}(?:\.\d{{1,4}})*)\s+[A-Z][^\n]{{0,80}}|[A-Z][A-Z \-]{{3,60}})\s*$"
CAPTION = r"(?im)^\s*(table|figure|fig\.?)\s*\d+[:.]\s.*$"
FORMULA = r"(?s)\$[^$]+\$|\\\[[^\]]+\\\]|\\begin\{equation\}.*?\\end\{equation\}"
PRESERVED = r"(?i)\b(appendix|supplementary results|supplementary material|supplementary information)\b.*"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
NOISE_LINE_CHARS = 200

#: Numbers of summaries (with thousands separators), and numbers of evidence (none inside names).
SUMMARY_NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
EVIDENCE_NUMBER = r"(?<![A-Za-z\d.])\d+(?:\.\d+)?%?(?![A-Za-z\d])"
