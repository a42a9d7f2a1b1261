"""SQL counterparts of the registered queries, written from their definitions for an engine with RE2 patterns."""

from quillspark.functions.text import LINE_END, WHITE
from quillspark.schemas import FIM_MIDDLE, FIM_PREFIX, FIM_SUFFIX, MASK

BLANK = rf"^{WHITE}*$"


def lines_of(text: str) -> str:
    cut = f"string_split_regex({text}, '{LINE_END}')"
    return f"(CASE WHEN {cut}[-1] = '' THEN {cut}[:-2] ELSE {cut} END)"


def strip_of(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{WHITE}+', ''), '{WHITE}+$', '')"


def draw(key: str, attempt: str, tag: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key} || ':' || {attempt} || ':{tag}'), 1, 8))::BIGINT"


def order_key(key: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || {key})"


def spans_of(source: str, key: str, text: str, samples: int = 5) -> str:
    """Table expressions that end in s(file_id, attempt, start, span_len, n_lines, prefix, suffix, middle, text)."""
    return f"""
    l AS (SELECT {key} AS file_id, {lines_of(text)} AS ls FROM {source}),
    n AS (SELECT file_id, ls, len(ls) AS n_lines FROM l WHERE len(ls) >= 10),
    a AS (SELECT *, unnest(range(0, {3 * samples})) AS attempt FROM n),
    b AS (SELECT *, 1 + {draw("file_id", "attempt", "len")} % (least(15, n_lines - 2)) AS span_len FROM a),
    c AS (SELECT *, 1 + {draw("file_id", "attempt", "start")} % (n_lines - span_len - 1) AS start FROM b),
    d AS (SELECT *, array_to_string(ls[1:start], chr(10)) AS prefix, array_to_string(ls[start + 1:start + span_len], chr(10)) AS middle,
                 array_to_string(ls[start + span_len + 1:], chr(10)) AS suffix FROM c),
    e AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY attempt) AS rn FROM d WHERE NOT regexp_matches(middle, '{BLANK}')),
    s AS (SELECT file_id, attempt::INTEGER AS attempt, start::INTEGER AS start, span_len::INTEGER AS span_len, n_lines::INTEGER AS n_lines, prefix, suffix, middle,
                 '{FIM_PREFIX}' || prefix || '{FIM_SUFFIX}' || suffix || '{FIM_MIDDLE}' || middle AS text FROM e WHERE rn <= {samples})"""


DOC_SPANS = "WITH " + spans_of("documents", "doc_id", "text")
FIRST = "k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY file_id, attempt) AS nth FROM s) WHERE nth = 1)"

SPANS = DOC_SPANS + " SELECT file_id, attempt, start, span_len, n_lines, md5(text) AS text_md5 FROM s"
DEDUP = DOC_SPANS + f", {FIRST} SELECT file_id, attempt, md5(text) AS text_md5 FROM k"
FLAGSHIP = DOC_SPANS + f", {FIRST} SELECT lang, count(*) AS n_records, sum(span_len)::BIGINT AS n_lines FROM k JOIN documents ON file_id = doc_id GROUP BY lang"
BUILD_STATS = (
    DOC_SPANS
    + f""", {FIRST} SELECT count(*) FILTER (doc_id % 10 <> 0) AS processed, count(*) FILTER (doc_id % 10 = 0) AS invalid, 0::BIGINT AS unreadable,
    (SELECT count(*) FROM s) AS raw, (SELECT count(*) FROM k) AS kept FROM documents"""
)
LINE_STATS = f"SELECT doc_id, len(ls)::BIGINT AS n_lines, len(list_filter(ls, lambda x: NOT regexp_matches(x, '{BLANK}')))::BIGINT AS n_filled FROM (SELECT doc_id, {lines_of('text')} AS ls FROM documents)"
STRIPPED = f"SELECT doc_id, length({strip_of('chr(12288) || chr(9) || chr(160) || text || chr(28) || chr(32) || chr(8232) || chr(10)')})::BIGINT AS n_chars FROM documents"
EXACT_DEDUP = "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"
SOURCE = "array_to_string(list_transform(range(0, p_size + 4), lambda i: 'line_' || i || ' = ' || i), chr(10))"
SYNTAX = "SELECT p_size, count(*) FILTER (p_partkey % 2 = 0) AS n_valid, count(*) FILTER (p_partkey % 2 = 1) AS n_invalid FROM part GROUP BY p_size"
VALID_SPANS = f"WITH src AS (SELECT p_partkey, {SOURCE} AS source FROM part WHERE p_partkey % 2 = 0), " + spans_of("src", "p_partkey", "source") + " SELECT file_id, attempt, start, span_len, md5(text) AS text_md5 FROM s"
SPLIT = f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {order_key("doc_id")}, doc_id::VARCHAR) <= floor(count(*) OVER () * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM documents"""
GROUP_SPLIT = f"""WITH g AS (SELECT DISTINCT source FROM documents),
    r AS (SELECT source, CASE WHEN row_number() OVER (ORDER BY {order_key("source")}, source) <= floor(count(*) OVER () * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM g)
    SELECT doc_id, source, split FROM documents JOIN r USING (source)"""
CAP = f"SELECT doc_id FROM documents ORDER BY {order_key('doc_id')}, doc_id LIMIT 500"
LANG_SAMPLE = f"""SELECT doc_id AS task_id, substr(text, 1, 20) AS prefix, substr(text, 21) AS suffix
    FROM (SELECT * FROM documents WHERE lang = 'en' ORDER BY {order_key("doc_id")}, doc_id LIMIT 100) WHERE doc_id % 3 = 0"""
HEAD = "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 200"
#: This engine's levenshtein counts bytes: the letters beyond ASCII that occur become control characters, one for one.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
CODES = " || ".join(f"chr({i})" for i in [*range(1, 9), *range(14, 27)])
TURNS = """t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS middle FROM conversations),
    r AS (SELECT * FROM t WHERE text IS NOT NULL AND middle IS NOT NULL)"""
BOTH = f"""{TURNS}, p AS (SELECT 'Base' AS model, conv_id, turn, {strip_of("text")} AS x, {strip_of("middle")} AS y FROM r
    UNION ALL SELECT 'LoRA-FT', conv_id, turn, {strip_of("substr(middle, 1, length(middle) // 2)")}, {strip_of("middle")} FROM r),
    z AS (SELECT model, conv_id, turn, (x = y)::INTEGER::DOUBLE AS exact_match,
          CASE WHEN length(x) = 0 AND length(y) = 0 THEN 1.0::DOUBLE WHEN length(x) = 0 OR length(y) = 0 THEN 0.0::DOUBLE
               ELSE 1 - levenshtein(translate(x, '{LETTERS}', {CODES}), translate(y, '{LETTERS}', {CODES}))::DOUBLE / greatest(length(x), length(y)) END AS edit_similarity FROM p)"""
EXACT_MATCH = f"WITH {BOTH} SELECT model, round(avg(exact_match), 6) AS exact_match FROM z GROUP BY model"
EDIT_SIMILARITY = f"WITH {BOTH} SELECT model, round(avg(exact_match), 6) AS exact_match, round(avg(edit_similarity), 6) AS edit_similarity FROM z GROUP BY model"
COMPARISON = f"WITH {BOTH} SELECT model, 'exact_match' AS metric, round(avg(exact_match), 6) AS value FROM z GROUP BY model UNION ALL SELECT model, 'edit_similarity', round(avg(edit_similarity), 6) FROM z GROUP BY model"
RUNNING = f"""WITH {BOTH}, m AS (SELECT model, row_number() OVER w AS position, count(*) OVER (PARTITION BY model) AS n, avg(exact_match) OVER w AS a, avg(edit_similarity) OVER w AS b
        FROM z WINDOW w AS (PARTITION BY model ORDER BY conv_id, turn))
    SELECT model, position, round(a, 6) AS exact_match, round(b, 6) AS edit_similarity FROM m WHERE position % 20 = 0 OR position = n"""
PROMPTS = f"""p AS (SELECT doc_id AS task_id, substr(text, 1, 30) AS prefix, substr(text, 31, 30) || CASE WHEN doc_id % 2 = 0 THEN '{MASK}' ELSE '' END || substr(text, 61) AS suffix FROM documents)"""
MASK_SPLIT = f"WITH {PROMPTS} SELECT * FROM p"
ASSEMBLY = f"WITH {PROMPTS} SELECT task_id, prefix || 'pass $1 \\ ' || task_id || suffix AS program FROM p"
JUDGED = """j AS (SELECT l_orderkey::VARCHAR AS task_id, 'Base' AS model, 1.0::DOUBLE AS passed FROM lineitem GROUP BY l_orderkey
    UNION ALL SELECT l_orderkey::VARCHAR, 'LoRA-FT', bool_and(l_quantity <= 45 AND l_returnflag <> 'A')::INTEGER::DOUBLE FROM lineitem GROUP BY l_orderkey)"""
JUDGE = f"WITH {JUDGED} SELECT task_id, model, passed FROM j"
PASS_AT_1 = f"WITH {JUDGED} SELECT model, round(avg(passed), 6) AS pass_at_1 FROM j GROUP BY model"
JSON_TESTS = "SELECT event_id, event_type AS input, json_extract_string(props, '$.k') AS first_output, 2::BIGINT AS n_outputs FROM events"
LOSS = """SELECT 'train' AS series, event_id AS step, round(value, 6) AS value FROM events WHERE event_id % 3 <> 0 AND value IS NOT NULL AND event_type IS NOT NULL
    UNION ALL SELECT 'eval', event_id, round(value / 2, 6) FROM events WHERE event_id % 5 = 0 AND value IS NOT NULL AND event_type IS NOT NULL"""
FINGERPRINT = "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN substr(sha256(text), 1, 16) ELSE 'unknown' END AS fingerprint FROM documents"
PROMPT = f"""SELECT p_partkey, '{FIM_PREFIX}' || p_name || '{FIM_SUFFIX}' || p_type || '{FIM_MIDDLE}' AS prompt,
    '{FIM_PREFIX}' || p_name || '{FIM_SUFFIX}' || p_type || '{FIM_MIDDLE}' || p_brand AS text FROM part"""
SENTINEL = "SELECT p_partkey, p_size % 4 = 0 AS has_sentinel FROM part"
RUN_ID = """SELECT p_partkey, substr('qwen' || (p_size // 10) || (p_size % 10) || 'b', 1, 8) || '-lora-r16-e' || p_size || '-ds' || CASE WHEN p_size % 2 = 0 THEN 'v2' ELSE 'v1' END
    || '-20260105-a' || CASE WHEN p_size % 3 = 0 THEN p_size ELSE 1 END AS run_id FROM part"""
CONFIG = """WITH x AS (SELECT max(p_size) AS e, min(p_size) AS b FROM part)
    SELECT unnest([['model/name', 'Org/Model-1'], ['model/max_seq_length', '2048'], ['lora/r', '16'], ['lora/alpha', '32'], ['lora/dropout', '0.5'], ['lora/target_modules', 'q,v'],
    ['training/num_epochs', e::VARCHAR], ['training/per_device_train_batch_size', b::VARCHAR], ['training/gradient_accumulation_steps', '4'], ['training/learning_rate', '0.25'],
    ['training/warmup_steps', '10'], ['training/lr_scheduler_type', 'cosine'], ['training/fp16', 'true'], ['training/seed', '42'], ['data/path', 'd.jsonl'], ['data/train_split', '0.5'],
    ['training/effective_batch_size', (4 * b)::VARCHAR], ['training/optim', 'adamw_torch'], ['data/sha256', 'unknown'], ['model/revision', 'unknown'], ['compute/gpu_type', 'unknown'],
    ['run/attempt', '1'], ['run/dataset_version', 'v1'], ['run/id', 'model1-lora-r16-e' || e || '-dsv1-20260105-a1']]) AS kv FROM x"""
CONFIG = f"SELECT kv[1] AS key, kv[2] AS value FROM ({CONFIG})"
NAMES = """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand END AS entity, CASE WHEN p_size % 2 = 0 THEN p_type || '/x' ELSE p_brand END AS project,
    'eval/' || CASE WHEN p_size % 3 = 0 THEN 'base' ELSE 'lora_ft' END || '/exact_match' AS metric, round(p_retailprice / 1024, 6) AS kb, round(p_retailprice * 1000 / 1048576, 6) AS mb FROM part"""
MODELFILE = """SELECT r_regionkey, md5(array_to_string(['# Modelfile for Qwen2.5-Coder-0.5B Python FIM', 'FROM ' || r_name || '.gguf', '', '# Qwen2.5-Coder FIM template',
    'TEMPLATE \"\"\"<|fim_prefix|>{{ .Prompt }}<|fim_suffix|><|fim_middle|>\"\"\"', '', 'PARAMETER stop \"<|endoftext|>\"', 'PARAMETER stop \"<|fim_middle|>\"',
    'PARAMETER stop \"<|fim_prefix|>\"', 'PARAMETER stop \"<|fim_suffix|>\"', ''], chr(10))) AS md5 FROM region"""
SOURCES = "SELECT source, count(*) AS n_files, sum(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY source"
MIX = "SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean_length, round(median(length(text)), 6)::DOUBLE AS median_length, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang"
RESULTS = "b AS (SELECT o_orderpriority AS model_name, o_orderstatus AS benchmark, CASE WHEN o_orderkey % 2 = 0 THEN 'none' ELSE 'q4' END AS quantization, avg(o_totalprice / 1000) AS v FROM orders GROUP BY ALL)"
PIVOT = f"""WITH {RESULTS} SELECT model_name || '/' || quantization AS model_name, round(max(v) FILTER (benchmark = 'F'), 4) AS bench_f, round(max(v) FILTER (benchmark = 'O'), 4) AS bench_o,
    round(max(v) FILTER (benchmark = 'P'), 4) AS bench_p FROM b GROUP BY ALL"""
RETENTION = f"WITH {RESULTS} SELECT x.model_name, x.benchmark, x.quantization, round(x.v / y.v, 6) AS retained FROM b x JOIN b y ON x.model_name = y.model_name AND x.benchmark = y.benchmark AND y.quantization = 'none' WHERE x.quantization = 'q4'"
SCATTER = f"WITH {RESULTS} SELECT model_name, benchmark, quantization, length(model_name) AS params, round(v, 4) AS value FROM b WHERE benchmark <> 'P'"
SCALARS = f"WITH {JUDGED} SELECT CASE WHEN model = 'Base' THEN 'eval/safim/base/pass_at_1' ELSE 'eval/safim/lora_ft/pass_at_1' END AS name, round(avg(passed), 6) AS value FROM j GROUP BY model"
RESULTS_ROWS = f"WITH {JUDGED} SELECT 'eval/safim/results_table' AS name, model, task_id, passed FROM j"
SOURCE_SPLIT = f"""WITH g AS (SELECT source, count(*) AS n, {order_key("source")} AS k FROM documents GROUP BY source),
    c AS (SELECT *, sum(n) OVER (ORDER BY k) - n AS before, floor(sum(n) OVER () * 0.9::DOUBLE) AS want FROM g),
    d AS (SELECT source, n, greatest(0, least(n, want - before))::BIGINT AS n_train FROM c)
    SELECT source, n_train, n - n_train AS n_val FROM d"""
#: The tree of sources: one file for each size and parity, the odd ones invalid.
TREE = f"""src AS (SELECT DISTINCT p_size, p_partkey % 2 AS odd, 'd' || (p_size % 3) || '/s' || p_size || '_' || (p_partkey % 2) || '.py' AS name,
    {SOURCE} || CASE WHEN p_partkey % 2 = 1 THEN chr(10) || 'def foo(:' ELSE '' END AS source FROM part), ok AS (SELECT name, source FROM src WHERE odd = 0)"""
CORPUS = f"WITH {TREE}, {spans_of('ok', 'name', 'source')}, {FIRST} SELECT md5(text) AS text_md5, md5(prefix) AS prefix_md5, md5(middle) AS middle_md5, md5(suffix) AS suffix_md5 FROM k"
#: Here the folders d0 to d2 are the roots, so that a file is known by its name alone.
CORPUS_COUNTERS = f"""WITH {TREE.replace("SELECT name, source FROM src", "SELECT split_part(name, '/', 2) AS name, source FROM src")}, {spans_of('ok', 'name', 'source')}, {FIRST}
    SELECT 'files' AS name, count(*) AS n FROM src UNION ALL SELECT 'unreadable', 0 UNION ALL SELECT 'invalid', count(*) FROM src WHERE odd = 1
    UNION ALL SELECT 'processed', count(*) FROM ok UNION ALL SELECT 'raw', count(*) FROM s UNION ALL SELECT 'kept', count(*) FROM k UNION ALL SELECT 'lines', count(*) FROM k
    UNION ALL SELECT 'bytes', sum(strlen(source))::BIGINT FROM src UNION ALL SELECT split_part(name, '/', 1), count(*) FROM src GROUP BY split_part(name, '/', 1)"""
TRAIN_TEXTS = f"""WITH t AS (SELECT coalesce(source, 'none') AS text FROM documents UNION ALL SELECT text FROM documents WHERE text IS NOT NULL),
    r AS (SELECT text, CASE WHEN row_number() OVER (ORDER BY {order_key("text")}) <= floor(count(*) OVER () * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM t)
    SELECT md5(text) AS text_md5, split, count(*) AS n FROM r GROUP BY ALL"""
JSONL = """SELECT role AS prefix, turn::VARCHAR AS middle, md5('"' || chr(92) || chr(9) || chr(8232) || text) AS suffix_md5, md5(text) AS text_md5 FROM conversations WHERE text IS NOT NULL"""
TASK_FILES = "SELECT doc_id::VARCHAR AS task_id, lang, 'block' AS config FROM documents WHERE lang IS NOT NULL AND doc_id % 3 = 0"
EXEC_SCORES = """SELECT * FROM (VALUES ('add', 'Base', 1.0::DOUBLE), ('add', 'LoRA-FT', 0.0), ('none', 'Base', 0.0), ('none', 'LoRA-FT', 0.0), ('late', 'Base', 1.0), ('late', 'LoRA-FT', 1.0)) AS v(task_id, model, passed)"""
SANDBOX = "SELECT * FROM (VALUES ('right', 1.0::DOUBLE), ('wrong', 0.0), ('fails', 0.0), ('endless', 0.0)) AS v(task_id, passed)"
BLOCKS = """SELECT p_partkey, kind, "start", "end" FROM part, (VALUES ('function', 0, 5), ('block', 2, 4)) AS v(kind, "start", "end")"""
