"""DuckDB SQL of the operators that SQL can express over whole tables."""

from __future__ import annotations

from agora.llm import decontam, mixing, quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"'[\x20\x09-\x0D]+'"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {_GAP}), lambda x: x <> '')"


def _shingles(words: str, length: int) -> str:
    joined = " || ' ' || ".join(f"{words}[i + {k}]" for k in range(length))
    return (
        f"list_distinct(CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) < {length} THEN [array_to_string({words}, ' ')] "
        f"ELSE list_transform(range(1, len({words}) - {length - 2}), lambda i: {joined}) END)"
    )


def _sets(table: str, key: str, length: int) -> str:
    lower = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return (
        f"(SELECT {key}, unnest({_shingles('w', length)}) AS s FROM (SELECT {key}, {_words(lower)} AS w FROM {table}))"
    )


def near_duplicates(shingle: int, percent: int) -> str:
    return f"""
    WITH RECURSIVE sets AS (FROM {_sets('documents', 'doc_id', shingle)}),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
        FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
    ),
    links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * k >= {percent} * (x.n + y.n - k)
    ),
    reached(doc_id, other) AS (
        SELECT doc_id, doc_id FROM documents
        UNION
        SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other
    ),
    named AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d JOIN named USING (doc_id) LEFT JOIN sizes USING (doc_id)
    """


def leaks() -> str:
    return f"""
    WITH items AS (FROM {_sets('benchmark', 'item_id', decontam.SHINGLE)}),
    sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
    sets AS (FROM {_sets('documents', 'doc_id', decontam.SHINGLE)})
    SELECT item_id, doc_id, any_value(n)::BIGINT AS item_shingles, count(*)::BIGINT AS shared_shingles
    FROM items JOIN sets USING (s) JOIN sizes USING (item_id)
    GROUP BY item_id, doc_id HAVING 100 * count(*) >= {decontam.PERCENT} * any_value(n)
    """


def source_mix(seed: int = 7) -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return f"""
    WITH counted AS (
        SELECT doc_id, source, {_words("coalesce(text, '')")} AS w FROM documents
    ),
    sized AS (
        SELECT doc_id, source, len(w)::BIGINT AS size,
            -ln((('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / {2**52}::DOUBLE)
                / ((1.0::DOUBLE + len(list_distinct(w))) / (1.0::DOUBLE + len(w))) AS key
        FROM counted
    ),
    sources AS (
        SELECT source, sum(size)::BIGINT AS source_size,
            ([{weights}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)]::DOUBLE AS weight
        FROM sized GROUP BY source
    ),
    levels AS (
        SELECT *, source_size * {mixing.MAX_EPOCHS}.0::DOUBLE AS most, source_size * {mixing.MAX_EPOCHS}.0::DOUBLE / weight AS full_at FROM sources
    ),
    filled AS (
        SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM levels WINDOW o AS (ORDER BY full_at, source NULLS LAST)
    ),
    targets AS (
        SELECT source, source_size, least(most, coalesce((SELECT arg_min(level, full_at) FROM filled WHERE level <= full_at) * weight, most)) AS target
        FROM filled
    ),
    budgets AS (
        SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {mixing.MAX_EPOCHS}) ELSE 0 END::BIGINT AS epochs FROM targets
    ),
    placed AS (
        SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS budget,
            coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
    )
    SELECT doc_id, size, source_size, target::DOUBLE AS target,
        ((epochs + CASE WHEN before + size / 2.0::DOUBLE <= budget THEN 1 ELSE 0 END) * size)::BIGINT AS taken
    FROM placed
    """


def _estimates(sums: str, consistency: float) -> str:
    """Query of group, start, m*, c* and size from a table of sums and the priors."""
    d, pairs, scale = range(quality.DIMENSIONS), quality._pairs(), quality.SCALE
    floors = list(quality.FLOORS.values())
    inner = ", ".join(
        [f"s{i}::DOUBLE / n::DOUBLE / {scale}::DOUBLE AS a{i}" for i in d]
        + [f"p{i}{j}::DOUBLE / n::DOUBLE / {scale * scale}::DOUBLE AS b{i}{j}" for i, j in pairs]
    )
    query = f'SELECT *, n::DOUBLE / (n + {quality.PRIOR}::DOUBLE) AS h, {inner} FROM {sums} JOIN priors USING ("group")'
    values = [f"h * a{i} + (1 - h) * o{i} AS m{i}" for i in d]
    for i, j in pairs:
        value = f"h * {consistency}::DOUBLE * (b{i}{j} - a{i} * a{j}) + h * (1 - h) * (a{i} - o{i}) * (a{j} - o{j})"
        values.append(value + (f" + (1 - h) * r{i} * r{i}" if i == j else "") + f" AS v{i}{j}")
    query = f"SELECT *, {', '.join(values)} FROM ({query})"
    for i, j in sorted(pairs, key=lambda pair: (pair[1], pair[0])):
        rest = f"v{i}{j}" + "".join(f" - c{i}{k} * c{j}{k}" for k in range(j))
        value = f"sqrt(greatest({rest}, {floors[i] ** 2!r}::DOUBLE))" if i == j else f"({rest}) / c{j}{j}"
        query = f"SELECT *, {value} AS c{i}{j} FROM ({query})"
    size = " + ".join(f"2 * ln(c{i}{i})" for i in d)
    return f'SELECT "group", start, {_PARAMETERS}, {size} AS size FROM ({query})'


_PARAMETERS = ", ".join([f"m{i}" for i in range(quality.DIMENSIONS)] + [f"c{i}{j}" for i, j in quality._pairs()])


def _distances(rows: str, parameters: str, how: str = "JOIN") -> str:
    inner = f'SELECT r.*, p.* EXCLUDE ("group") FROM {rows} r {how} {parameters} p USING ("group")'
    for i in range(quality.DIMENSIONS):
        value = f"x{i} / {quality.SCALE}::DOUBLE - m{i}" + "".join(f" - c{i}{k} * z{k}" for k in range(i))
        inner = f"SELECT *, ({value}) / c{i}{i} AS z{i} FROM ({inner})"
    total = " + ".join(f"z{i} * z{i}" for i in range(quality.DIMENSIONS))
    return f"SELECT *, {total} AS d2 FROM ({inner})"


def _quartiles(level: str) -> str:
    unit = quality.WIDTH / quality.SCALE
    columns = []
    for i, floor in enumerate(quality.FLOORS.values()):
        columns.append(f"max((middle + 0.5::DOUBLE) * {unit!r}::DOUBLE) FILTER (WHERE dimension = {i}) AS o{i}")
        spread = f"greatest((high - low) * {unit / 1.349!r}::DOUBLE, {floor!r}::DOUBLE)"
        columns.append(f"max({spread}) FILTER (WHERE dimension = {i}) AS r{i}")
    shares = ", ".join(
        f"min(bucket) FILTER (WHERE upto >= total * {share}::DOUBLE) AS {name}"
        for name, share in (("low", 0.25), ("middle", 0.5), ("high", 0.75))
    )
    return f"""SELECT "{level}", {", ".join(columns)} FROM (
        SELECT "{level}", dimension, {shares} FROM (
            SELECT *, sum(here) OVER (PARTITION BY "{level}", dimension ORDER BY bucket) AS upto,
                sum(here) OVER (PARTITION BY "{level}", dimension) AS total
            FROM (SELECT "{level}", dimension, bucket, sum(here) AS here FROM buckets GROUP BY ALL)
        ) GROUP BY ALL
    ) GROUP BY ALL"""


def _plain(start: int, quartiles: str) -> str:
    factors = ", ".join(f"r{i} AS c{i}{j}" if i == j else f"0.0::DOUBLE AS c{i}{j}" for i, j in quality._pairs())
    means = ", ".join(f"o{i} AS m{i}" for i in range(quality.DIMENSIONS))
    return f'SELECT "group", {start} AS start, {means}, {factors} FROM {quartiles}'


#: Steps that the SQL writes out: groups rest after fewer on the small tables.
_WRITTEN_STEPS = 16


def quality_rules() -> str:
    d, window, scale = quality.DIMENSIONS, quality.WINDOW, quality.SCALE
    moments = ", ".join(
        ["count(*) AS n"]
        + [f"sum(x{i}) AS s{i}" for i in range(d)]
        + [f"sum(x{i}::HUGEINT * x{j}) AS p{i}{j}" for i, j in quality._pairs()]
    )
    windows = " || ' ' || ".join(f"w[i + {k}]" for k in range(window))
    steps = [
        f"""texts AS (
            SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, {_words("coalesce(text, '')")} AS w FROM documents
        )""",
        f"""places AS (
            SELECT r, unnest(range(1, len(w) - {window - 2})) AS i, unnest(list_transform(range(1, len(w) - {window - 2}), lambda i: {windows})) AS s
            FROM texts WHERE len(w) >= {window}
        )""",
        "again AS (SELECT r, i FROM places QUALIFY count(*) OVER (PARTITION BY r, s) > 1)",
        f"""repeats AS (
            SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, range({window}) AS t(k) GROUP BY r
        )""",
        f"""counts AS (
            SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                length(regexp_replace(t, '[^{quality.SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols,
                length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g'))::BIGINT AS n_capitals,
                list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
                coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
            FROM texts LEFT JOIN repeats USING (r)
        )""",
        f"""stats AS (
            SELECT *, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
                coalesce('=' || lang, '') AS l, coalesce('=' || source, '') AS s FROM counts
        )""",
        f"""vectors AS MATERIALIZED (
            SELECT *, length(l) || ':' || l || s AS "group", l AS wider,
                round(ln((word_chars + {quality.MORE_CHARS})::DOUBLE / (n_words + {quality.MORE_WORDS})) * {scale})::BIGINT AS x0,
                round(ln(1.0::DOUBLE + 100.0::DOUBLE * n_symbols / (n_words + {quality.MORE_WORDS})) * {scale})::BIGINT AS x1,
                round(n_dup_lines::DOUBLE / (n_lines + {quality.MORE_LINES}) * {scale})::BIGINT AS x2,
                round(n_repeat_words::DOUBLE / (n_words + {quality.MORE_WORDS}) * {scale})::BIGINT AS x3,
                round(sqrt((n_capitals + {quality.MORE_CAPITALS}::DOUBLE) / (word_chars + {quality.MORE_CHARS})) * {scale})::BIGINT AS x4
            FROM stats
        )""",
        f"""used AS MATERIALIZED (SELECT "group", wider, {", ".join(f"x{i}" for i in range(d))} FROM vectors WHERE NOT base_failed)""",
        "buckets AS MATERIALIZED ("
        + " UNION ALL ".join(
            f'SELECT "group", wider, {i} AS dimension, floor(x{i} / {quality.WIDTH}::DOUBLE)::BIGINT AS bucket, count(*) AS here FROM used GROUP BY ALL'
            for i in range(d)
        )
        + ")",
        f"""priors AS MATERIALIZED (
            SELECT * EXCLUDE (wider) FROM (SELECT DISTINCT "group", wider FROM used) JOIN ({_quartiles("wider")}) USING (wider)
        )""",
        f'everything AS (SELECT "group", 0 AS start, {moments} FROM used GROUP BY ALL)',
        f"""state0 AS MATERIALIZED (
            SELECT *, 'Infinity'::DOUBLE AS size, true AS moving FROM (
                SELECT * EXCLUDE (size) FROM ({_estimates("everything", 1.0)}) UNION ALL BY NAME
                {_plain(1, f"({_quartiles('group')})")} UNION ALL BY NAME {_plain(2, "priors")}
            )
        )""",
    ]
    names = quality._SUMS
    for k in range(1, _WRITTEN_STEPS + 1):
        moving = f"(SELECT * EXCLUDE (size, moving) FROM state{k - 1} WHERE moving)"
        changed = ", ".join(f"CASE WHEN falls THEN e.{c} ELSE s.{c} END AS {c}" for c in [*_PARAMETERS.split(", "), "size"])
        steps += [
            f"""sums{k} AS (
                SELECT "group", start, floor(ln(1.0::DOUBLE + d2) * {quality.FINE})::BIGINT AS bucket, {moments}
                FROM ({_distances("used", moving)}) GROUP BY ALL
            )""",
            f"""near{k} AS (
                SELECT "group", start, {", ".join(f"sum({c}) AS {c}" for c in names)} FROM (
                    SELECT *, sum(n) OVER (PARTITION BY "group", start) AS total,
                        coalesce(sum(n) OVER (PARTITION BY "group", start ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                    FROM sums{k}
                ) WHERE before < total * {quality.HALF}::DOUBLE GROUP BY ALL
            )""",
            f"step{k} AS MATERIALIZED ({_estimates(f'near{k}', quality.CONSISTENCY)})",
            f"""state{k} AS MATERIALIZED (
                SELECT s."group", s.start, {changed}, falls AS moving FROM (
                    SELECT s.*, coalesce(e.size < s.size - {quality.FALLS}::DOUBLE, false) AS falls
                    FROM state{k - 1} s LEFT JOIN step{k} e USING ("group", start)
                ) s LEFT JOIN step{k} e USING ("group", start)
            )""",
        ]
    last = f"state{_WRITTEN_STEPS}"
    steps += [
        f'best AS (SELECT "group", {_PARAMETERS} FROM {last} QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY size, start) = 1)',
        f"final AS ({_distances('vectors', 'best', 'LEFT JOIN')})",
    ]
    return f"""
    WITH {", ".join(steps)}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND NOT coalesce(d2 > {quality.CUTOFF}::DOUBLE, false) AS kept, round(d2, 6) AS distance
    FROM final
    """


def hard_negatives() -> str:
    return """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.x, r.x)::BIGINT AS score
  FROM usable a JOIN usable r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
