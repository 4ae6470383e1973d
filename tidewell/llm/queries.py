"""The queries of this subpackage, by name, and their SQL where SQL can say
the same over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from . import filter_audit, target_sampling
from .byte_bpe import op10_byte_bpe
from .filter_audit import op12_filter_audit
from .fingerprints import op5_fingerprints
from .html_text import op6_html_text
from .jaccard import op2_ngram_jaccard
from .licenses import op11_license_scan
from .media import op1_media_columns
from .mixing import op8_mix_sources
from .quality import op9_quality_resampling
from .rans import op4_token_output
from .target_sampling import op13_target_resampling
from .token_counts import op3_token_counts
from .toxicity import op7_toxicity


def queries() -> dict[str, Callable]:
    return {
        "op1_media_columns": op1_media_columns,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_token_counts": op3_token_counts,
        "op4_token_output": op4_token_output,
        "op5_fingerprints": op5_fingerprints,
        "op6_html_text": op6_html_text,
        "op7_toxicity": op7_toxicity,
        "op8_mix_sources": op8_mix_sources,
        "op9_quality_resampling": op9_quality_resampling,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_license_scan": op11_license_scan,
        "op12_filter_audit": op12_filter_audit,
        "op13_target_resampling": op13_target_resampling,
    }


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Shingle sets, links by an inverted index of distinct sets, and their closure.
_NGRAM_JACCARD = rf"""with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') w from documents),
 x as (select doc_id, unnest(w) w, generate_subscripts(w, 1) i from w), y as (select doc_id, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o g from x window o as (partition by doc_id order by i)),
 g as materialized (select distinct doc_id, md5(g) g from y where g is not null union all select doc_id, md5(array_to_string(w, ' ')) from w where len(w) between 1 and 3),
 s as (select doc_id, count(*) n, md5(string_agg(g, '' order by g)) h from g group by doc_id), r as materialized (select h, min(doc_id) rep, any_value(n) n from s group by h),
 m as (select doc_id, g, n from g join r on doc_id = rep), l as materialized (select a.doc_id a, b.doc_id b from m a join m b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
 e as (select a, b from l union select b, a from l), c as (select rep a, rep b from r union select c.a, e.b from c join e on c.b = e.a), k as (select a, min(b) c from c group by a)
 select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(k.c, d.doc_id) as component_id from documents d left join s using (doc_id) left join r using (h) left join k on k.a = r.rep"""
#: The driver's pages mark their articles, and these hold headings, paragraphs
#: and inline tags only.
_MAIN_TEXT = r"""with b as (select page_id, url, string_split_regex(replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<br>', ' '), '</?(?:h1|p)>') b from pages),
 t as (select page_id, url, array_to_string(list_filter(list_transform(b, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) t from b)
 select page_id, url, t as text, length(t) as n_chars from t"""


def oracle_sql() -> dict[str, str]:
    """Tokenizers, hashes that SQL lacks, learned models and seeded draws are
    beyond SQL; tests compare those with brute force."""
    return {"op2_ngram_jaccard": _NGRAM_JACCARD, "op6_html_text": _MAIN_TEXT, "op12_filter_audit": filter_audit.ORACLE_SQL, "op13_target_resampling": target_sampling.ORACLE_SQL}
