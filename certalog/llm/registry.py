"""Queries of this subpackage, and the SQL of those that SQL can state."""

from certalog.llm.ann import op10_nearest
from certalog.llm.decontaminate import op1_decontamination
from certalog.llm.html import op6_html
from certalog.llm.lines import op9_lines
from certalog.llm.packing import op4_packing
from certalog.llm.periods import op12_runs
from certalog.llm.quality import op3_quality
from certalog.llm.secrets import op5_secrets
from certalog.llm.simhash import op8_simhash
from certalog.llm.sketches import op11_fingerprints
from certalog.llm.substrings import op2_substrings
from certalog.llm.toxicity import op7_toxicity
from certalog.llm.whitening import op13_whitening

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_substrings": op2_substrings,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_secrets": op5_secrets,
    "op6_html": op6_html,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_lines": op9_lines,
    "op10_nearest": op10_nearest,
    "op11_fingerprints": op11_fingerprints,
    "op12_runs": op12_runs,
    "op13_whitening": op13_whitening,
}

ORACLE = {
    "op2_substrings": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
v as (select doc_id, ws, unnest(range(1, len(ws) - 18)) p from w where len(ws) >= 20),
r as (select doc_id, p, row_number() over (partition by array_to_string(list_slice(ws, p, p + 19), ' ') order by doc_id, p) n from v),
g as (select distinct doc_id, unnest(range(p, p + 20)) k from r where n > 1),
x as (select doc_id, unnest(ws) word, unnest(range(1, len(ws) + 1)) k from w),
k as (select x.doc_id, count(g.k) n_removed, sha256(coalesce(string_agg(case when g.k is null then word end, ' ' order by x.k), '')) kept_sha256
  from x left join g on x.doc_id = g.doc_id and x.k = g.k group by 1)
select w.doc_id, len(ws) n_words, coalesce(n_removed, 0) n_removed, coalesce(kept_sha256, sha256('')) kept_sha256 from w left join k using (doc_id)
""",
}
