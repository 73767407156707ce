"""DuckDB SQL with the results of the library's queries; what it cannot express (look-around, learning) is left out."""

from __future__ import annotations

from corpusloom.functions.style import EMOJI_RUN, INTERJECTIONS, REGIONAL
from corpusloom.plans.queries import PROMPTS

_B = r"\t-\r\x1c-\x20\x{85}\p{Z}"
_W = r"\p{L}\p{N}_"
_REG = "['casual','email_prof','academic'][(doc_id % 3 + 1)::INT]"
_PROMPTS = "(VALUES " + ", ".join(f"('{r}', {i}, '{p}')" for r, i, p in PROMPTS) + ") AS p(register, pos, prompt)"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{_B}]+|[{_B}]+$', '', 'g')"


def _normal(c: str) -> str:
    return f"regexp_replace(lower({_strip(c)}), '[{_B}]+', ' ', 'g')"


def _words(c: str) -> str:
    return f"regexp_extract_all({c}, '[^{_B}]+')"


def _runs(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[{_W}]+')"


def _links(c: str) -> str:
    for pattern, token in (
        (rf"https?://[^{_B}]+", "URL"),
        (rf"\b[{_W}.+-]+@[{_W}-]+\.[{_W}.-]+\b", "EMAIL"),
        (rf"@[{_W}]{{3,}}", "HANDLE"),
        (rf"-?\p{{Nd}}{{1,2}}\.\p{{Nd}}{{4,}},[{_B}]*-?\p{{Nd}}{{1,3}}\.\p{{Nd}}{{4,}}", "COORDS"),
        (r"\b\p{Nd}{22}\b", "CBU"),
        (r"\b[A-Z]{2}\p{Nd}{2}[A-Z0-9]{4,30}\b", "IBAN"),
    ):
        c = f"regexp_replace({c}, '{pattern}', '<{token}>', 'g')"
    return c


def _cut(c: str) -> str:
    head = f"substr({c}, 1, 600)"
    ended = rf"regexp_extract({head}, '(?s)^(.*(?:[.!?](?:[{_B}]|$)|\n\n))', 1)"
    return f"CASE WHEN length({c}) <= 600 THEN {c} WHEN {ended} <> '' THEN {_strip(ended)} ELSE regexp_replace({head}, '[{_B}]+$', '') END"


def _until(lines: str, pattern: str) -> str:
    at = f"list_position(list_transform({lines}, lambda s: regexp_matches({_strip('s')}, '{pattern}')), true)"
    return f"CASE WHEN coalesce({at}, 0) > 0 THEN {lines}[1:{at} - 1] ELSE {lines} END"


_ITEMS = f"items AS (SELECT doc_id, text, {_REG} AS register FROM documents)"
_ONCE = f"once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY register, sha1({_normal('text')}) ORDER BY doc_id) AS k FROM items) WHERE k = 1)"
_SPLIT = """CASE WHEN rk <= round(n * {test}) THEN 'test' WHEN rk <= round(n * {test}) + round((n - round(n * {test})) * ({val} / (1 - {test}))) THEN 'val' ELSE 'train' END"""
_DATASET = f"""{_ITEMS}, {_ONCE},
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY register ORDER BY md5('42|' || doc_id), doc_id) AS r FROM once) WHERE r <= 1000),
pr AS (SELECT c.doc_id, c.register, c.text AS original, p.prompt FROM capped c JOIN {_PROMPTS} ON p.register = c.register AND p.pos = ('0x' || substr(md5('42|' || c.doc_id), 1, 8))::BIGINT % 4),
fm AS (SELECT doc_id, register, original, '<start_of_turn>user' || chr(10) || prompt || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) || original || '<end_of_turn>' || chr(10) AS text FROM pr),
ok AS (SELECT * FROM fm WHERE len({_words('text')}) <= 2048),
rk AS (SELECT *, row_number() OVER (PARTITION BY register ORDER BY md5('42|' || doc_id), doc_id) AS rk, count(*) OVER (PARTITION BY register) AS n FROM ok),
built AS (SELECT doc_id, register, {_SPLIT.format(test='0.1::DOUBLE', val='0.1::DOUBLE')} AS split, text, original FROM rk)"""
_REPEATED = f"""pg AS (SELECT source, doc_id AS page_no, string_split(text, chr(10)) AS ls FROM documents),
np AS (SELECT source, count(*) AS n FROM pg GROUP BY source HAVING count(*) >= 3),
ln AS (SELECT source, {_strip('raw')} AS line, count(*) AS c FROM (SELECT source, unnest(list_distinct(ls)) AS raw FROM pg) GROUP BY ALL),
rl AS (SELECT ln.source, line FROM ln JOIN np USING (source) WHERE line <> '' AND c::DOUBLE / n >= 0.02)"""
_METRIC = f"""
st AS (SELECT doc_id, text, list_filter({_runs('text')}, lambda x: length(x) > 1) AS t, {_runs('text')} AS r, {_words('text')} AS w,
       list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '[^{_B}]')) AS s FROM documents),
sv AS (SELECT doc_id, coalesce(len(list_distinct(t)) / nullif(len(t), 0)::DOUBLE, 0) AS ttr,
       coalesce(list_sum(list_transform(s, lambda x: len({_words('x')})))::DOUBLE / nullif(len(s), 0), 0) AS avg_sentence_length,
       coalesce(len(list_filter(r, lambda x: x IN ({', '.join(f"'{x}'" for x in REGIONAL)}))) * 100.0::DOUBLE / nullif(len(w), 0), 0) AS regional_rate,
       coalesce(len(regexp_extract_all(text, '{EMOJI_RUN}')) * 100.0::DOUBLE / nullif(length(text), 0), 0) AS emoji_density,
       coalesce(len(list_filter(r, lambda x: x IN ({', '.join(f"'{x}'" for x in INTERJECTIONS)}))) * 100.0::DOUBLE / nullif(len(w), 0), 0) AS interjection_rate FROM st)"""
_LONG = """lg AS (SELECT sample, m.metric, m.value FROM (SELECT CASE WHEN quality = 1 THEN 'real' ELSE 'generated' END AS sample, unnest([
       {metric: 'ttr', value: ttr}, {metric: 'avg_sentence_length', value: avg_sentence_length}, {metric: 'regional_rate', value: regional_rate},
       {metric: 'emoji_density', value: emoji_density}, {metric: 'interjection_rate', value: interjection_rate}]) AS m FROM sv JOIN labels USING (doc_id)))"""
_TOKENS = f"tk AS (SELECT doc_id, token, count(*) AS c FROM (SELECT doc_id, unnest({_runs('text')}) AS token FROM documents) GROUP BY ALL)"
_NLL = f"""{_TOKENS}, mo AS (SELECT token, sum(c) AS f FROM tk GROUP BY token), tt AS (SELECT sum(f) + count(*) AS t FROM mo),
nl AS (SELECT doc_id, sum(-c * ln((f + 1)::DOUBLE / t)) AS nll_sum, sum(c)::BIGINT AS n_tokens FROM tk JOIN mo USING (token), tt GROUP BY doc_id)"""
_GUESS = "gs AS (SELECT quality AS y, (n_chars > 600)::INT AS g FROM labels JOIN documents USING (doc_id))"
_PAIRS = f"""{_ITEMS},
re AS (SELECT register, text AS real, row_number() OVER (PARTITION BY register ORDER BY md5('42|real|' || doc_id)) AS k FROM items),
pp AS (SELECT register, prompt, row_number() OVER (PARTITION BY register ORDER BY md5('42|prompt|' || register || '|' || pos)) AS k FROM {_PROMPTS}),
z0 AS (SELECT re.register, re.k, real, prompt FROM re JOIN pp USING (register, k) WHERE k <= 10),
z1 AS (SELECT *, register || '_' || lpad((row_number() OVER (ORDER BY register, k) - 1)::VARCHAR, 3, '0') AS id FROM z0),
z AS (SELECT *, ('0x' || substr(md5('42|coin|' || id), 1, 8))::BIGINT % 2 = 0 AS f, {_cut('real')} AS a, {_cut("(register || ': ' || reverse(prompt))")} AS b FROM z1)"""
_STOP = r"(?:(?i)^>)|(?:(?i)^On .+ <.+@.+> wrote:)|(?:(?i)^El .+ escribió:)|(?:^-{3,})|(?:^_{3,})|(?:^--$)|(?:(?i)^Enviado desde mi (?:iPhone|Android|iPad))|(?:(?i)^Este mensaje y sus adjuntos)|(?:(?i)^This email and any attachments)|(?:(?i)^CONFIDENTIAL(?:[^\p{L}\p{N}_]|$))"
_LINE = rf"(?i)^\[?(\p{{Nd}}{{1,2}}/\p{{Nd}}{{1,2}}/\p{{Nd}}{{2,4}}),?[{_B}]+(\p{{Nd}}{{1,2}}:\p{{Nd}}{{2}}(?::\p{{Nd}}{{2}})?(?:[{_B}]*[ap]\.?[{_B}]*m\.?)?)\]?[{_B}]*[–\-]?[{_B}]*(.+?):[{_B}]+(.*)"
_SYS = "(?i)<Multimedia omitido>|imagen omitida|audio omitido|video omitido|sticker omitido|Se cifran los mensajes|Los mensajes y las llamadas|cambió el asunto|añadió a|eliminó a|salió del grupo"


def _gram(table: str, ident: str) -> str:
    return f"SELECT DISTINCT {ident}, array_to_string(r[k:k + 7], ' ') AS gram FROM (SELECT {ident}, r, unnest(range(1, len(r) - 6)) AS k FROM (SELECT {ident}, {_runs('text')} AS r FROM {table}))"


_HOUR = rf"(?i)\b\p{{Nd}}{{1,2}}:\p{{Nd}}{{2}}(?::\p{{Nd}}{{2}})?[{_B}]*(?:[ap]\.?[{_B}]*m\.?)?\b"
#: What may not stand beside a number is taken with it and put back; the second pass finds those whose neighbour was taken.
_PHONE = rf"(^|[^:\p{{Nd}}])(\+?\p{{Nd}}[\p{{Nd}}{_B}\-().]{{6,}}\p{{Nd}})($|[^:/\p{{Nd}}])"


def _masked(c: str) -> str:
    phone = lambda x: rf"regexp_replace(regexp_replace({x}, '{_PHONE}', '\1<PHONE>\3', 'g'), '{_PHONE}', '\1<PHONE>\3', 'g')"
    pieces, hours = f"regexp_split_to_array({_links(c)}, '{_HOUR}')", f"regexp_extract_all({_links(c)}, '{_HOUR}')"
    joined = f"array_to_string(list_transform(list_zip({pieces}, {hours}), lambda z: {phone('z[1]')} || coalesce(z[2], '')), '')"
    return rf"regexp_replace(regexp_replace({joined}, '\b\p{{Nd}}{{7,8}}\b', '<ID>', 'g'), '\b\p{{Nd}}{{9,}}\b', '<NUM>', 'g')"


def _own(c: str) -> str:
    head = f"string_split(regexp_split_to_array({c}, '(?is)El .{{5,80}} escribió:|De:.*\\nEnviado:.*\\nPara:.*\\n')[1], chr(10))"
    return _strip(f"array_to_string({_until(head, _STOP)}, chr(10))")


_TAIL = "(0.2316419 * z + 1)"
_P = "least(1, 2 * ((1 / t) * (0.319381530::DOUBLE + (1 / t) * (-0.356563782::DOUBLE + (1 / t) * (1.781477937::DOUBLE + (1 / t) * (-1.821255978::DOUBLE + (1 / t) * 1.330274429::DOUBLE))))) * exp(-z * z / 2) / 2.5066282746310002::DOUBLE)"
_LINES = "SELECT conv_id, turn, '3/1/24, 10:' || lpad((turn % 60)::VARCHAR, 2, '0') || ' - ' || role || ': ' || text AS v FROM conversations"

ALL: dict[str, str] = {
    "chat_files": f"""WITH l1 AS (SELECT conv_id, turn, unnest(string_split(v, chr(10))) AS line, unnest(range(0, len(string_split(v, chr(10))))) AS k FROM ({_LINES})), l2 AS (SELECT *, {_strip("regexp_replace(line, '[‎‏]', '', 'g')")} AS l FROM l1),
p AS (SELECT *, regexp_matches(l, '{_LINE}') AS st, {_strip(f"regexp_extract(l, '{_LINE}', 3)")} AS author, {_strip(f"regexp_extract(l, '{_LINE}', 4)")} AS body FROM l2),
i AS (SELECT *, sum(st::INT) OVER (PARTITION BY conv_id ORDER BY turn, k ROWS UNBOUNDED PRECEDING) AS isl FROM p),
g AS (SELECT conv_id, isl, arg_min(author, (turn, k)) AS author, {_strip("string_agg(CASE WHEN st THEN body ELSE l END, ' ' ORDER BY turn, k)")} AS text FROM i WHERE isl > 0 AND (st OR l <> '') GROUP BY ALL)
SELECT md5(text) AS text_md5, 'casual' AS register, count(*) AS n FROM g WHERE lower(upper(author)) = 'user' AND length(text) >= 30 AND NOT regexp_matches(text, '{_SYS}') GROUP BY ALL""",
    "chat_match_rate": f"SELECT count(*) AS total_lines, count(*) FILTER (regexp_matches({_strip("regexp_replace(line, '[‎‏]', '', 'g')")}, '{_LINE}')) AS matched_lines FROM (SELECT unnest(string_split(v, chr(10))) AS line FROM ({_LINES}))",
    "mailbox": f"""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN regexp_replace('<p>' || text || '</p>', '<[^>]+>', ' ', 'g') ELSE text END AS body FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 2 AND doc_id % 7 <> 0),
o AS (SELECT doc_id, {_own('body')} AS text FROM b) SELECT 'Año ' || doc_id AS subject, 'email_prof' AS register, md5(text) AS text_md5 FROM o WHERE length(text) >= 100""",
    "docx_texts": f"SELECT 'in/' || doc_id || '.docx' AS source, (CASE WHEN doc_id % 10 <> 0 THEN 0 ELSE -1 END)::BIGINT AS page_no, CASE WHEN doc_id % 10 <> 0 THEN md5(array_to_string(list_filter(string_split(text, chr(10)), lambda s: {_strip('s')} <> ''), chr(10))) END AS text_md5, doc_id % 10 = 0 AS failed FROM documents",
    "file_counts": "SELECT count(*) FILTER (doc_id % 10 <> 0) AS processed, count(*) FILTER (doc_id % 10 = 0) AS failed FROM documents",
    "jsonl_files": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents",
    "split_files": f"WITH {_DATASET}, b AS (SELECT split, register, text FROM built UNION ALL SELECT 'valid', register, text FROM built WHERE split = 'val') SELECT split, register, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM b GROUP BY ALL",
    "test_texts": f"WITH {_DATASET} SELECT register, md5(original) AS text_md5 FROM built WHERE split = 'test'",
    "prompt_files": f"SELECT register, pos::BIGINT AS pos, prompt FROM {_PROMPTS}",
    "dataset_digests": f"""WITH {_DATASET}, h AS (SELECT split, sha256(original || chr(31) || register || chr(31) || text) AS h FROM built),
s AS (SELECT split, count(*) AS rows, sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT)::VARCHAR AS a, sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT)::VARCHAR AS b FROM h GROUP BY split) SELECT split, "rows", sha256(a || '-' || b) AS sha256 FROM s""",
    "dataset_manifest": f"""WITH {_DATASET}, h AS (SELECT split, sha256(original || chr(31) || register || chr(31) || text) AS h FROM built),
s AS (SELECT split, count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT)::VARCHAR || '-' || sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT)::VARCHAR AS v FROM h GROUP BY split),
r AS (SELECT register, count(*) AS n FROM built WHERE split = 'train' GROUP BY register), q AS (SELECT register, sha1(string_agg(prompt, chr(10) ORDER BY pos)) AS v FROM {_PROMPTS} GROUP BY register)
SELECT 42 AS seed, 1000 AS max_per_register, (SELECT '{{' || string_agg('"' || split || '":' || n, ',' ORDER BY split) || '}}' FROM s) AS counts, (SELECT '{{' || string_agg('"' || register || '":' || n, ',' ORDER BY register) || '}}' FROM r) AS train_by_register,
(SELECT '{{' || string_agg('"' || split || '":"' || sha256(v) || '"', ',' ORDER BY split) || '}}' FROM s) AS sha256, (SELECT '{{' || string_agg('"' || register || '":"' || v || '"', ',' ORDER BY register) || '}}' FROM q) AS prompts_sha1""",
    "blind_files": f"WITH {_PAIRS} SELECT id, register, CASE WHEN f THEN 'a' ELSE 'b' END AS real_position, md5(CASE WHEN f THEN a ELSE b END) AS a_md5, md5(CASE WHEN f THEN b ELSE a END) AS b_md5 FROM z",
    "kept_generations": f"SELECT register, pos::BIGINT AS pos, CASE WHEN pos < 2 THEN register || ': ' || reverse(prompt) ELSE upper(prompt) END AS generated FROM {_PROMPTS}",
    "event_lines": """SELECT conv_id, turn, 'data: ' || CASE WHEN turn % 5 = 4 THEN '{"done":true,"eval_count":' || conv_id || ',"tokens_per_sec":' || conv_id || '.0}' ELSE '{"token":"' || role || '"}' END || chr(10) || chr(10) AS line FROM conversations""",
    "result_summary": "SELECT count(*)::DOUBLE AS documents, NULL::DOUBLE AS accuracy, true AS dated FROM documents",
    "call_statuses": """WITH s AS (SELECT event_id, CASE WHEN event_id * 37 % 200 > 120 THEN 504 WHEN event_id % 11 = 0 THEN 500 ELSE 200 END AS status FROM events), t AS (SELECT *, CASE status WHEN 504 THEN 'upstream_timeout' WHEN 500 THEN 'internal' END AS e FROM s)
SELECT event_id, status, CASE WHEN event_id % 2 = 0 THEN 'data: {"error":"' || e || '"}' || chr(10) || chr(10) ELSE e END AS told FROM t""",
    "generated_tails": f"SELECT doc_id, md5({_strip("regexp_replace('<b> ' || text || ' </b>' || chr(10), '<[^>]*>', '', 'g')")}) AS text_md5 FROM documents",
    "ended_texts": "SELECT doc_id, md5(text || '</s>') AS text_md5 FROM documents",
    "name_masks": r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)\bthe\b', '<LOC>', 'g'), '(?i)\bder\b', '<PER>', 'g')) AS text_md5 FROM documents",
    "all_masks": f"SELECT doc_id, {_masked('text')} AS masked FROM documents",
    "document_chunks": f"""WITH d AS (SELECT doc_id::VARCHAR AS source, {_words(_masked('text'))} AS w FROM documents WHERE length({_strip('text')}) >= 500), k AS (SELECT source, w, unnest(range(0, greatest(0, ceil((len(w) - 400) / 350.0))::BIGINT + 1)) AS k FROM d WHERE len(w) > 0),
c AS (SELECT source, k::INT AS chunk_no, array_to_string(w[k * 350 + 1:k * 350 + 400], ' ') AS c FROM k), f AS (SELECT *, row_number() OVER (PARTITION BY sha1({_normal('c')}) ORDER BY source, chunk_no) AS r FROM c WHERE length(c) >= 200)
SELECT source, chunk_no, md5({_masked('c')}) AS text_md5 FROM f WHERE r = 1""",
    "rank_p_values": f"""WITH {_METRIC}, {_LONG}, rr AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY metric, value) AS t FROM lg),
g AS (SELECT metric, count(*) FILTER (sample = 'real')::DOUBLE AS n1, count(*) FILTER (sample <> 'real')::DOUBLE AS n2, sum(r) FILTER (sample = 'real') AS r1, sum(t::DOUBLE * t - 1) AS ties FROM rr GROUP BY metric),
v AS (SELECT *, n1 + n2 AS n, r1 - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 12 * ((n1 + n2 + 1) - ties / nullif((n1 + n2) * (n1 + n2 - 1), 0)) AS var FROM g),
x AS (SELECT metric, var, greatest((abs(u - n1 * n2 / 2) - 0.5) / sqrt(var), 0)::DOUBLE AS z FROM v WHERE var > 0), y AS (SELECT *, {_TAIL}::DOUBLE AS t FROM x)
SELECT v.metric, CASE WHEN t IS NOT NULL THEN round({_P}, 6) END AS p_value FROM v LEFT JOIN y ON v.metric = y.metric""",
    "flagship": f"SELECT lang, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY sha1({_normal('text')}) ORDER BY doc_id) AS k FROM (SELECT doc_id, lang, {_links('text')} AS text FROM documents)) WHERE k = 1 GROUP BY lang",
    "length_filter": "SELECT doc_id, length(text)::INT AS n FROM documents WHERE length(text) >= 100",
    "forbidden_tokens": r"SELECT doc_id, regexp_matches(text, '(?i)<start_of_turn>|<end_of_turn>|<bos>|<eos>|<\|[^|]+\|>|\[CASUAL\]|\[EMAIL-PROF\]|\[ACADÉMICO\]') AS forbidden FROM documents",
    "subject_stopwords": "SELECT * FROM (SELECT doc_id, string_split(text, chr(10))[1] AS subject FROM documents) WHERE NOT (contains(lower(subject), 'the') OR contains(lower(subject), 'que') OR contains(lower(subject), 'newsletter'))",
    "request_validation": f"""WITH r AS (SELECT conv_id, turn, text AS prompt, ['casual', 'professional', 'other'][(turn % 3 + 1)::INT] AS register, conv_id * 37 % 2500 AS mt FROM conversations),
v AS (SELECT *, list_filter([CASE WHEN length({_strip("coalesce(prompt, '')")}) < 1 THEN 'prompt_empty' END, CASE WHEN length({_strip("coalesce(prompt, '')")}) > 4000 THEN 'prompt_too_long' END,
     CASE WHEN register = 'other' THEN 'register_unknown' END, CASE WHEN mt < 1 OR mt > 2000 THEN 'max_tokens_out_of_range' END], lambda x: x IS NOT NULL) AS vs FROM r)
SELECT conv_id, turn, coalesce(array_to_string(vs, ','), '') AS violations, CASE WHEN len(vs) > 0 THEN 422 WHEN regexp_matches(prompt, '(?i)<start_of_turn>|<end_of_turn>|<bos>|<eos>|<\\|[^|]+\\|>|\\[CASUAL\\]|\\[EMAIL-PROF\\]|\\[ACADÉMICO\\]') THEN 400 ELSE 200 END AS status,
(length(prompt) + CASE WHEN register = 'professional' THEN 13 ELSE 9 END)::INT AS tagged_length FROM v""",
    "head": "SELECT doc_id, substr(text, 1, 500) AS shown FROM documents ORDER BY doc_id LIMIT 10",
    "normal_hashes": f"SELECT doc_id, sha1({_normal('text')}) AS key FROM documents",
    "chunks": f"""WITH w AS (SELECT doc_id, {_words('text')} AS w FROM documents), k AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 400) / 350.0))::BIGINT + 1)) AS k FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, k::INT AS chunk_no, array_to_string(w[k * 350 + 1:k * 350 + 400], ' ') AS c FROM k) SELECT doc_id, chunk_no, md5(c) AS chunk_md5, length(c)::INT AS n FROM c""",
    "html_texts": "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS text_md5 FROM pages",
    "sentence_cut": f"SELECT doc_id, {_cut('text')} AS cut FROM documents",
    "style_token_counts": f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct FROM (SELECT doc_id, list_filter({_runs('text')}, lambda x: length(x) > 1) AS t FROM documents)",
    "link_masks": f"SELECT doc_id, {_links('text')} AS masked FROM documents",
    "number_masks": r"SELECT doc_id, regexp_replace(regexp_replace(text, '\b\p{Nd}{7,8}\b', '<ID>', 'g'), '\b\p{Nd}{9,}\b', '<NUM>', 'g') AS masked FROM documents",
    "first_occurrences": f"WITH {_ITEMS}, {_ONCE} SELECT doc_id, register FROM once",
    "capped": f"WITH {_ITEMS} SELECT doc_id, register FROM (SELECT *, row_number() OVER (PARTITION BY register ORDER BY md5('42|' || doc_id), doc_id) AS r FROM items) WHERE r <= 1000",
    "dataset_split": f"WITH {_ITEMS}, rk AS (SELECT *, row_number() OVER (PARTITION BY register ORDER BY md5('42|' || doc_id), doc_id) AS rk, count(*) OVER (PARTITION BY register) AS n FROM items) SELECT doc_id, register, {_SPLIT.format(test='0.1::DOUBLE', val='0.1::DOUBLE')} AS split FROM rk",
    "label_split": f"WITH s AS (SELECT doc_id, quality || '-' || {_REG} AS stratum FROM labels), rk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || doc_id), doc_id) AS rk, count(*) OVER (PARTITION BY stratum) AS n FROM s) SELECT doc_id, stratum, {_SPLIT.format(test='0.2::DOUBLE', val='0::DOUBLE')} AS split FROM rk",
    "prompt_assignment": f"WITH {_ITEMS} SELECT doc_id, i.register, prompt FROM items i JOIN {_PROMPTS} ON p.register = i.register AND p.pos = ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT % 4",
    "built_dataset": f"WITH {_DATASET} SELECT doc_id, register, split, md5(text) AS text_md5 FROM built",
    "dataset_counts": f"WITH {_DATASET} SELECT split, register, count(*) AS n FROM built GROUP BY ALL",
    "repeated_page_lines": f"WITH {_REPEATED} SELECT source, line FROM rl",
    "pages_without_repeats": f"""WITH {_REPEATED}, l AS (SELECT source, page_no, unnest(ls) AS raw, unnest(range(1, len(ls) + 1)) AS pos FROM pg),
k AS (SELECT l.* FROM l ANTI JOIN rl ON l.source = rl.source AND {_strip('l.raw')} = rl.line), b AS (SELECT source, page_no, string_agg(raw, chr(10) ORDER BY pos) AS t FROM k GROUP BY ALL)
SELECT pg.source, pg.page_no, md5(coalesce(t, '')) AS text_md5 FROM pg LEFT JOIN b ON pg.source = b.source AND pg.page_no = b.page_no""",
    "clean_pages": f"WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: NOT regexp_matches({_strip('s')}, '^\\p{{Nd}}{{1,4}}$')) AS ls FROM documents) SELECT doc_id, md5(array_to_string({_until('ls', '(?i)^(?:References|Bibliography|Bibliografía|Referencias|Works Cited|Fuentes)$')}, chr(10))) AS text_md5 FROM l",
    "mail_texts": f"WITH h AS (SELECT doc_id, string_split(regexp_split_to_array(text, '(?is)El .{{5,80}} escribió:|De:.*\\nEnviado:.*\\nPara:.*\\n')[1], chr(10)) AS ls FROM documents) SELECT doc_id, md5({_strip(f"array_to_string({_until('ls', _STOP)}, chr(10))")}) AS text_md5 FROM h",
    "chat_messages": f"""WITH l0 AS (SELECT conv_id AS file, turn, string_split('3/1/24, 10:' || lpad((turn % 60)::VARCHAR, 2, '0') || ' - ' || role || ': ' || text, chr(10)) AS ls FROM conversations),
l1 AS (SELECT file, turn, unnest(ls) AS line, unnest(range(0, len(ls))) AS k FROM l0), l2 AS (SELECT file, turn * 100000 + k AS pos, {_strip("regexp_replace(line, '[‎‏]', '', 'g')")} AS l FROM l1),
p AS (SELECT *, regexp_matches(l, '{_LINE}') AS st, {_strip(f"regexp_extract(l, '{_LINE}', 3)")} AS author, {_strip(f"regexp_extract(l, '{_LINE}', 4)")} AS body FROM l2),
i AS (SELECT *, sum(st::INT) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isl FROM p),
g AS (SELECT file, isl, min(pos) AS pos, arg_min(author, pos) AS author, {_strip("string_agg(CASE WHEN st THEN body ELSE l END, ' ' ORDER BY pos)")} AS text FROM i WHERE isl > 0 AND (st OR l <> '') GROUP BY ALL)
SELECT file, pos, text FROM g WHERE lower(upper(author)) = 'user' AND length(text) >= 30 AND NOT regexp_matches(text, '{_SYS}')""",
    "style_vectors": f"WITH {_METRIC} SELECT doc_id, round(ttr, 6) AS ttr, round(avg_sentence_length, 6) AS avg_sentence_length, round(regional_rate, 6) AS regional_rate, round(emoji_density, 6) AS emoji_density, round(interjection_rate, 6) AS interjection_rate FROM sv",
    "rank_sums": f"""WITH {_METRIC}, {_LONG}, rd AS (SELECT sample, metric, round(value, 9) AS value FROM lg),
rr AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0::DOUBLE AS r FROM rd)
SELECT metric, count(*) FILTER (sample = 'real') AS n1, count(*) FILTER (sample <> 'real') AS n2, (sum(r) FILTER (sample = 'real') - count(*) FILTER (sample = 'real') * (count(*) FILTER (sample = 'real') + 1) / 2.0)::DOUBLE AS u FROM rr GROUP BY metric""",
    "style_comparison": f"""WITH {_METRIC}, {_LONG}, m AS (SELECT metric, avg(value) FILTER (sample = 'real') AS r, avg(value) FILTER (sample <> 'real') AS g FROM lg GROUP BY metric),
d AS (SELECT *, abs(r - g) / nullif(abs(r), 0) * 100 AS dp FROM m) SELECT metric, round(r, 6) AS real, round(g, 6) AS generated, round(dp, 6) AS diff_pct, CASE WHEN dp < 20 THEN 'pass' WHEN dp IS NOT NULL THEN 'fail' END AS verdict FROM d""",
    "unigram_scores": f"WITH {_NLL} SELECT doc_id, round(nll_sum, 4) AS nll_sum, n_tokens FROM nl",
    "perplexity_gain": f"""WITH {_NLL}, b AS (SELECT {_REG} AS register, exp(sum(nll_sum) / sum(n_tokens)) AS pb FROM nl GROUP BY 1),
t2 AS (SELECT {_REG} AS register, doc_id, token, c FROM tk), m2 AS (SELECT register, token, sum(c) AS f FROM t2 GROUP BY ALL), s2 AS (SELECT register, sum(f) + count(*) AS t FROM m2 GROUP BY register),
n2 AS (SELECT register, doc_id, sum(-c * ln((f + 1)::DOUBLE / t)) AS s, sum(c) AS n FROM t2 JOIN m2 USING (register, token) JOIN s2 USING (register) GROUP BY ALL),
o AS (SELECT register, exp(sum(s) / sum(n)) AS po, count(*) AS n FROM n2 GROUP BY register)
SELECT register, n, round(pb, 4) AS ppl_base, round(po, 4) AS ppl_tuned, round((pb - po) / pb * 100, 4) AS gain_pct, (pb - po) / pb * 100 >= 20 AS passed FROM b JOIN o USING (register)""",
    "bootstrap_interval": f"""WITH {_NLL}, {_ITEMS}, rk AS (SELECT *, row_number() OVER (PARTITION BY register ORDER BY md5('42|' || doc_id), doc_id) AS rk, count(*) OVER (PARTITION BY register) AS n FROM items),
s AS (SELECT nl.*, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS i FROM nl SEMI JOIN (SELECT doc_id FROM rk WHERE rk <= round(n * 0.1::DOUBLE)) q USING (doc_id)), n AS (SELECT count(*) AS n FROM s),
d AS (SELECT r, ('0x' || substr(md5('42|' || r || '|' || s.i), 1, 8))::BIGINT % n.n AS i FROM range(1000) t(r), s, n), p AS (SELECT r, exp(sum(nll_sum) / sum(n_tokens)) AS ppl FROM d JOIN s USING (i) GROUP BY r)
SELECT round(quantile_cont(ppl, 0.5), 4) AS median, round(quantile_cont(ppl, 0.025), 4) AS ci_low, round(quantile_cont(ppl, 0.975), 4) AS ci_high FROM p""",
    "bootstrap_difference": """WITH v AS (SELECT toxic = 1 AS real, n_chars::DOUBLE AS v, row_number() OVER (PARTITION BY toxic = 1 ORDER BY md5('42|' || doc_id), doc_id) - 1 AS i, count(*) OVER (PARTITION BY toxic = 1) AS n FROM labels JOIN documents USING (doc_id)),
d AS (SELECT real, r, ('0x' || substr(md5('42|' || r || '|' || i), 1, 8))::BIGINT % n AS i FROM range(1000) t(r), v), m AS (SELECT d.real, r, avg(v.v) AS a FROM d JOIN v ON d.real = v.real AND d.i = v.i GROUP BY ALL),
x AS (SELECT abs(a.a - b.a) AS d FROM m a JOIN m b ON a.r = b.r AND a.real AND NOT b.real) SELECT round(quantile_cont(d, 0.025), 4) AS ci_low, round(quantile_cont(d, 0.975), 4) AS ci_high FROM x""",
    "guess_report": f"""WITH {_GUESS}, c AS (SELECT DISTINCT unnest([y, g]) AS class FROM gs), t AS (SELECT class, count(*) FILTER (y = class) AS s, count(*) FILTER (g = class) AS m, count(*) FILTER (y = class AND g = class) AS h FROM c, gs GROUP BY class)
SELECT class, round(coalesce(h::DOUBLE / nullif(m, 0), 0), 6) AS precision, round(coalesce(h::DOUBLE / nullif(s, 0), 0), 6) AS recall, round(coalesce(2.0 * h::DOUBLE / nullif(s + m, 0), 0), 6) AS f1, s AS support FROM t""",
    "guess_accuracy": f"""WITH {_GUESS}, a AS (SELECT count(*) AS n, sum((y = g)::BIGINT)::BIGINT AS correct FROM gs), p AS (SELECT *, correct::DOUBLE / n AS p FROM a),
w AS (SELECT *, 1 + 1.96 * 1.96 / n AS den, p + 1.96 * 1.96 / (2 * n) AS mid, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) AS mar FROM p)
SELECT n, correct, round(p, 6) AS accuracy, round(greatest(0, (mid - mar) / den), 6) AS ci_low_95, round(least(1, (mid + mar) / den), 6) AS ci_high_95, CASE WHEN p < 0.6 THEN 'excellent' WHEN p < 0.75 THEN 'acceptable' ELSE 'insufficient' END AS verdict FROM w""",
    "balanced_heads": "WITH n AS (SELECT least(min(c), 50) AS m FROM (SELECT count(*) AS c FROM labels GROUP BY quality)) SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r FROM labels), n WHERE r <= m",
    "blind_test": f"WITH {_PAIRS} SELECT id, register, CASE WHEN f THEN a ELSE b END AS text_a, CASE WHEN f THEN b ELSE a END AS text_b FROM z",
    "blind_key": f"WITH {_PAIRS} SELECT id, register, CASE WHEN f THEN 'a' ELSE 'b' END AS real_position, prompt AS prompt_used FROM z",
    "benchmark_leakage": f"SELECT doc_id, item_id, count(*) AS shared FROM ({_gram('documents', 'doc_id')}) JOIN ({_gram('benchmark', 'item_id')}) USING (gram) GROUP BY ALL",
    "prompt_coverage": f"WITH {_ITEMS}, w AS (SELECT doc_id, {_runs('text')} AS r FROM items) SELECT doc_id, pos::BIGINT AS pos FROM w, (VALUES (0, ['the', 'of', 'and']), (1, ['de', 'la', 'que']), (2, ['und', 'die', 'der'])) AS s(pos, ws) WHERE list_has_all(r, ws)",
    "register_union": f"WITH {_ITEMS} SELECT register, count(*) AS n FROM items GROUP BY register",
    "rate_limits": "SELECT event_id, date_trunc('hour', ts) AS window_start, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) > 3 AS limited FROM events",
    "concurrent_calls": 'WITH m AS (SELECT event_type, ts AS t, 1 AS d FROM events UNION ALL SELECT event_type, ts + INTERVAL 30 MINUTE, -1 FROM events), n AS (SELECT event_type, t, sum(d) AS d FROM m GROUP BY ALL), r AS (SELECT event_type, t, (sum(d) OVER (PARTITION BY event_type ORDER BY t ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM n) SELECT event_type, t AS "at", running, running > 3 AS "over" FROM r',
    "tumbling_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "sliding_windows": "SELECT window_start, event_type, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS window_start, event_type FROM events) GROUP BY ALL",
    "session_windows": "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, s",
    "token_rates": "SELECT event_id, round_even(user_id / (coalesce(nullif(event_id * 1000003 % 5000000000, 0), 1) / 1e9::DOUBLE), 1) AS rate FROM events",
    "token_streams": "WITH p AS (SELECT conv_id, turn, text AS token, turn % 5 = 4 AS done FROM conversations WHERE turn % 3 <> 2), b AS (SELECT *, coalesce(sum(done::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) SELECT conv_id, turn, token, done FROM b WHERE b = 0",
    "event_streams": "SELECT conv_id, turn, text AS tokens FROM conversations",
    "model_states": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'error' WHEN contains(lang, 'en') THEN 'ok' ELSE 'degraded' END AS status FROM documents",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n_rows FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "regional_revenue": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "order_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "top_orders": "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 2",
}
