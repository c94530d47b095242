"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from desense.llm import quality as q

#: Token patterns of the two tokenizer versions.
V1 = r"[^\x20\x09-\x0D]+"
V2 = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[!-/:-@\[-`{-~]"

OP2 = r"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '') AS query
  FROM r
), c AS (
  SELECT page_id, host, path,
    CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
      || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)='))) AS kept FROM p)
), listed AS (
  SELECT DISTINCT canonical FROM c
  WHERE regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.')
), j AS (
  SELECT c.*, l.canonical IS NOT NULL AS listed,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM c LEFT JOIN listed l ON c.canonical = l.canonical
)
SELECT page_id, host, path, rule, listed,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""

OP9 = rf"""
WITH d AS (
  SELECT doc_id, source, lang, text,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{V1}')) END AS v1,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{V2}')) END AS v2,
    min(doc_id) OVER (PARTITION BY text) AS first_id
  FROM documents
)
SELECT source, lang, CASE WHEN v1 <> v2 THEN 'words-v2' ELSE 'words-v1' END AS tokenizer_version,
  count(*)::BIGINT AS docs, sum(CASE WHEN v1 <> v2 THEN v2 ELSE v1 END)::BIGINT AS tokens
FROM d WHERE text IS NULL OR doc_id = first_id
GROUP BY ALL
"""


def op3() -> str:
    """The base counts by list functions, then the same starts, steps and shares of the
    parents' estimates as grouped SQL."""
    dims, pairs = range(q.P), q.PAIRS
    xs = ", ".join(q.X)
    params = ", ".join([f"m{i}" for i in dims] + [f"c{i}{j}" for i, j in pairs])

    def factored(source: str) -> list[str]:
        """Common table expressions that end in one named ``source``_l."""
        ctes, prev = [], source
        for j in dims:
            diagonal = f"c{j}{j}" + "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
            ctes.append(f"{source}_d{j} AS (SELECT *, sqrt({diagonal}) AS l{j}{j} FROM {prev})")
            below = "".join(f", (c{i}{j}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, q.P))
            ctes.append(f"{source}_e{j} AS (SELECT *{below} FROM {source}_d{j})")
            prev = f"{source}_e{j}"
        return [*ctes, f"{source}_l AS (SELECT * FROM {prev})"]

    def distance(rows: str, source: str) -> list[str]:
        ctes, prev = [], f"(SELECT r.*, p.* EXCLUDE (grp) FROM {rows} r JOIN {source}_l p ON r.grp = p.grp)"
        for i in dims:
            rest = f"x{i} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i))
            ctes.append(f"{source}_z{i} AS (SELECT *, ({rest}) / l{i}{i} AS z{i} FROM {prev})")
            prev = f"{source}_z{i}"
        return [*ctes, f"{source}_z AS (SELECT *, {' + '.join(f'z{i} * z{i}' for i in dims)} AS d2 FROM {prev})"]

    def moments(source: str, consistency: float) -> str:
        means = ", ".join(f"s{i} / k AS m{i}" for i in dims)
        cov = ", ".join(f"(q{i}{j} / k - m{i} * m{j}) * {consistency}::DOUBLE + {float(q.FLOORS[i] ** 2) if i == j else 0.0}::DOUBLE AS c{i}{j}" for i, j in pairs)
        return f"SELECT grp, start, n, {', '.join(f'm{i}' for i in dims)}, {cov} FROM (SELECT *, {means} FROM {source})"

    def drawn(own: str, parent: str) -> str:
        mixed = ", ".join(f"(e.n * e.{c} + {q.PRIOR} * p.{c}) / (e.n + {q.PRIOR}) AS {c}" for c in params.split(", "))
        return f"SELECT e.grp, e.n, {mixed} FROM {own} e JOIN {parent} p ON e.up = p.grp"

    middle = ", ".join(f"m{i}" for i in dims)
    by_range = ", ".join(f"d{i} * d{i} + {float(q.FLOORS[i] ** 2)}" if i == j else "0.0::DOUBLE" for i, j in pairs)
    floors = ", ".join(f"{float(q.FLOORS[i] ** 2) if i == j else 0.0}::DOUBLE" for i, j in pairs)
    names = [f"s{i}" for i in dims] + [f"q{i}{j}" for i, j in pairs]
    sums = ", ".join([f"sum(x{i}) AS s{i}" for i in dims] + [f"sum(x{i} * x{j}) AS q{i}{j}" for i, j in pairs])
    ctes = [
        r"""w0 AS (SELECT *, row_number() OVER () AS rid,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents)""",
        f"w1 AS (SELECT *, [array_to_string(w[i : i + {q.WINDOW - 1}], ' ') FOR i IN range(1, len(w) - {q.WINDOW - 2})] AS wins FROM w0)",
        "wx AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM (SELECT rid, unnest(wins) AS win, unnest(range(1, len(wins) + 1)) AS i FROM w1))",
        f"rep AS (SELECT rid, sum(least({q.WINDOW}, nxt - i))::BIGINT AS n_repeat_words FROM (SELECT rid, i, lead(i, 1, i + {q.WINDOW}) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM wx WHERE c > 1) GROUP BY rid)",
        r"""st AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w1 LEFT JOIN rep USING (rid))""",
        "base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM st)",
        f"""rows_g AS (SELECT *, '2' || to_json({{'l': lang, 's': source}})::VARCHAR AS grp, '1' || to_json({{'l': lang}})::VARCHAR AS up,
  least(floor(ln(1 + word_chars / n_words::DOUBLE) * {q.SCALE} + 0.5), {q.CLIP})::BIGINT AS x0,
  least(floor(sqrt(n_symbols / n_words::DOUBLE) * {q.SCALE} + 0.5), {q.CLIP})::BIGINT AS x1,
  least(floor(sqrt(10 * n_dup_lines / n_words::DOUBLE) * {q.SCALE} + 0.5), {q.CLIP})::BIGINT AS x2,
  least(floor(sqrt(n_repeat_words / n_words::DOUBLE) * {q.SCALE} + 0.5), {q.CLIP})::BIGINT AS x3
  FROM base WHERE NOT base_failed)""",
        f"lv AS (SELECT unnest([grp, up, '0']) AS grp, {xs} FROM rows_g)",
        f"lg AS (SELECT grp, unnest([{', '.join(str(i) for i in dims)}]) AS dim, unnest([{xs}]) AS v FROM lv)",
        "lc AS (SELECT grp, dim, v, count(*) AS c FROM lg GROUP BY ALL)",
        "lb AS (SELECT *, sum(c) OVER (PARTITION BY grp, dim ORDER BY v) AS below, sum(c) OVER (PARTITION BY grp, dim) AS total FROM lc)",
        "lq AS (SELECT grp, dim, max(total)::BIGINT AS n, " + ", ".join(f"min(CASE WHEN 4 * below >= {k} * total THEN v END) AS q{k}" for k in (1, 2, 3)) + " FROM lb GROUP BY ALL)",
        "mid AS (SELECT grp, max(n) AS n, " + ", ".join(f"max(CASE WHEN dim = {i} THEN q2 END)::DOUBLE AS m{i}, (max(CASE WHEN dim = {i} THEN q3 END) - max(CASE WHEN dim = {i} THEN q1 END)) / 1.349::DOUBLE AS d{i}" for i in dims) + " FROM lq GROUP BY grp)",
        f"al AS (SELECT grp, 2 AS start, n, n::DOUBLE AS k, {', '.join(f'{c}::DOUBLE AS {c}' for c in names)} FROM (SELECT grp, count(*) AS n, {sums} FROM lv GROUP BY grp))",
        f"s0 (grp, start, n, {params}) AS (SELECT grp, 0, n, {middle}, {by_range} FROM mid UNION ALL SELECT grp, 1, n, {middle}, {floors} FROM mid UNION ALL {moments('al', 1.0)})",
        *factored("s0"),
    ]
    for t in range(q.STEPS):
        ctes += distance("lv", f"s{t}")
        ctes += [
            f"b{t} AS (SELECT grp, start, n, least(floor(log2(1 + d2) * {q.BIN_SCALE}), {q.BINS}) AS bin, count(*) AS k, {sums} FROM s{t}_z GROUP BY ALL)",
            f"a{t} AS (SELECT *, sum(k) OVER (PARTITION BY grp, start ORDER BY bin) - k AS before FROM b{t})",
            f"k{t} AS (SELECT grp, start, max(n) AS n, sum(k)::DOUBLE AS k, {', '.join(f'sum({c})::DOUBLE AS {c}' for c in names)} FROM a{t} WHERE before < ceil(n * {q.COVERAGE}::DOUBLE) GROUP BY grp, start)",
            f"s{t + 1} AS ({moments(f'k{t}', q.CONSISTENCY)})",
            *factored(f"s{t + 1}"),
        ]
    det = " * ".join(f"l{i}{i}" for i in dims)
    ctes += [
        f"est AS (SELECT grp, n, {params} FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {det}, start) AS place FROM s{q.STEPS}_l) WHERE place = 1)",
        f"lng AS ({drawn('(SELECT *, $$0$$ AS up FROM est WHERE grp LIKE $$1%$$)', 'est')})",
        f"fin AS ({drawn('(SELECT est.*, up FROM est JOIN (SELECT DISTINCT grp, up FROM rows_g) USING (grp))', 'lng')})",
        *factored("fin"), *distance("rows_g", "fin"),
    ]
    out = "doc_id, " + ", ".join(q.STATS)
    return f"""WITH {", ".join(ctes)}
SELECT {out}, base_failed, d2 <= {q.CUTOFF} AS kept FROM fin_z
UNION ALL SELECT {out}, base_failed, false FROM base WHERE base_failed"""
