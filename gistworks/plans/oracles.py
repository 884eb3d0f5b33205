"""The registered queries as SQL for DuckDB, to compare results with.

Views come first, then one statement per query. Every statement runs over the
whole tables and texts. Summary-level subsequences have none: they are tested
against brute force.
"""

from __future__ import annotations

from gistworks.functions import porter
from gistworks.functions.text import ANSWER_MARKER, CHAT_BUDGET, INSTRUCTION, TEXT_MARKER
from gistworks.functions.tokenizer import UP_TO_TOKEN
from gistworks.operators.resample import PRIME, thresholds
from gistworks.plans.queries import ENC_MAX_LEN, GEN_MAX_LEN, SEED, UNSTEMMED, VOCAB_SIZE

_VIEWS = {
    "pairs": """
        SELECT doc_id AS id, (['arxiv','pubmed','govreport','bigpatent'])[doc_id % 4 + 1] AS dataset,
          CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, text,
          CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 13 = 0 THEN text
               WHEN doc_id % 11 = 0 THEN string_split(text, chr(10))[-1]
               ELSE array_to_string(list_filter(w, lambda x, i: i % 3 = 1), ' ') END AS summary,
          array_to_string(list_filter(w, lambda x, i: i % 5 IN (1, 4)), ' ') AS prediction
        FROM (SELECT *, string_split(text, ' ') AS w FROM documents)""",
    "corpora": "SELECT * REPLACE (id // 4 AS id) FROM pairs",
    "attempts": """
        SELECT id, 1 AS attempt, id % 5 <> 0 AS ok, CASE WHEN id % 5 <> 0 THEN prediction END AS output FROM pairs
        UNION ALL
        SELECT id, 2, id % 25 <> 0, CASE WHEN id % 25 <> 0 THEN 'retry ' || prediction END
        FROM pairs WHERE id % 5 = 0""",
    "run_predictions": """
        SELECT 'lead-3.5-turbo-' || dataset AS run_id, id, prediction FROM pairs
        UNION ALL
        SELECT 'skip-' || dataset || '-4096-15062023193353', id, reverse(prediction)
        FROM pairs WHERE id % 9 <> 0
        UNION ALL
        SELECT 'echo-' || dataset, id, summary FROM pairs""",
    "run_scores": """
        SELECT concat(source, '-', (['arxiv','pubmed','govreport'])[n % 3 + 1],
                      CASE WHEN n % 2 = 0 THEN '-4096-15062023193353' ELSE '' END) AS folder,
          CASE WHEN n % 2 = 0 THEN concat('{"rouge": ', j, '}') ELSE j END AS json
        FROM (SELECT source, n, concat('{"rouge1": 0.', 100 + n * 7 % 800, ', "rouge2": 0.', 100 + n * 3 % 800,
                     ', "rougeL": 0.', 100 + n * 5 % 800, ', "rougeLsum": 0.', 100 + n * 6 % 800, '}') AS j
              FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS n FROM documents))""",
    "scores": """
        SELECT folder,
          coalesce(json_extract_string(json, '$.rouge.rouge1'), json_extract_string(json, '$.rouge1'))::DOUBLE AS rouge1,
          coalesce(json_extract_string(json, '$.rouge.rouge2'), json_extract_string(json, '$.rouge2'))::DOUBLE AS rouge2,
          coalesce(json_extract_string(json, '$.rouge.rougeL'), json_extract_string(json, '$.rougeL'))::DOUBLE AS "rougeL",
          coalesce(json_extract_string(json, '$.rouge.rougeLsum'), json_extract_string(json, '$.rougeLsum'))::DOUBLE
            AS "rougeLsum"
        FROM run_scores""",
    "pred_logs": """
        SELECT concat('run', CAST(g AS VARCHAR), '-', (['arxiv','pubmed','govreport'])[g % 3 + 1]) AS folder,
          CASE WHEN g % 4 = 0 THEN concat('["', array_to_string(l, '", "'), '"]')
               ELSE concat(array_to_string(l, chr(10)), chr(10)) END AS content
        FROM (SELECT id // 10 AS g, list(regexp_replace(prediction, '[^a-zA-Z0-9 ]', '', 'g') ORDER BY id) AS l
              FROM pairs GROUP BY 1)""",
    "log_items": """
        SELECT folder, unnest(range(len(l)))::INTEGER AS position, unnest(l) AS prediction
        FROM (SELECT folder, CASE WHEN contains(content, chr(10))
                THEN string_split(regexp_replace(content, '\\n$', ''), chr(10))
                ELSE from_json(content, '["VARCHAR"]') END AS l FROM pred_logs)""",
    "eval_log": """
        SELECT user_id AS run_id, event_id AS step, floor(value) / 1000 AS eval_rouge1 FROM events""",
    "token_vectors": """
        SELECT vec_id // 20 AS pair_id, CAST(vec_id % 2 AS INTEGER) AS side, vec_id AS pos, embedding::DOUBLE[] AS v
        FROM embeddings""",
    "admitted": """
        SELECT * FROM pairs
        WHERE 2 * length(summary) < length(text) AND length(text) < 1000 * length(summary)
          AND NOT contains(text, summary)""",
    "prompt_lengths": f"""
        SELECT id, len(regexp_extract_all(lower('{INSTRUCTION}{TEXT_MARKER}' || text), '[a-z0-9]+'))::BIGINT AS num_tok
        FROM pairs""",
    "vocab": f"""
        SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) + 2)::INTEGER AS token_id
        FROM (SELECT token, count(*) AS n
              FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM pairs
                    UNION ALL
                    SELECT unnest(regexp_extract_all(lower(summary), '[a-z0-9]+')) FROM pairs)
              GROUP BY token)
        QUALIFY token_id <= {VOCAB_SIZE + 2}""",
    "aligned": """
        SELECT run_id, id, p.prediction, pairs.summary AS reference
        FROM run_predictions p JOIN pairs USING (id)""",
    "bert": """
        WITH cosines AS (
          SELECT p.pair_id, p.pos AS pp, r.pos AS rp, list_cosine_similarity(p.v, r.v) AS c
          FROM token_vectors p JOIN token_vectors r ON p.pair_id = r.pair_id AND p.side = 0 AND r.side = 1),
        pr AS (SELECT pair_id, avg(m) AS precision
               FROM (SELECT pair_id, pp, max(c) AS m FROM cosines GROUP BY ALL) GROUP BY pair_id),
        rc AS (SELECT pair_id, avg(m) AS recall
               FROM (SELECT pair_id, rp, max(c) AS m FROM cosines GROUP BY ALL) GROUP BY pair_id)
        SELECT pair_id, precision, recall,
          CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f
        FROM pr JOIN rc USING (pair_id)""",
}

_VIEW_ORDER = list(_VIEWS)


def _with(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` below the views it needs, further CTEs after them."""
    extra = extra or {}
    needed: set[str] = set()
    texts = [body, *extra.values()]
    for name in reversed(_VIEW_ORDER):
        if any(_mentions(t, name) for t in texts):
            needed.add(name)
            texts.append(_VIEWS[name])
    ctes = {n: _VIEWS[n] for n in _VIEW_ORDER if n in needed} | extra
    if not ctes:
        return body
    listed = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items())
    return f"WITH {listed}\n{body}"


def _mentions(sql: str, name: str) -> bool:
    words = sql.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return name in words


def _tokens(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '[a-z0-9]+')"


def _bigrams(tokens: str) -> str:
    return f"list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || ' ' || {tokens}[i + 1])"


def _gram_hits(source: str, keys: str, n: int) -> dict[str, str]:
    """CTEs giving ``hits<n>`` (keys, hits) of a frame with columns p and r of tokens."""
    grams = {1: ("p", "r"), 2: (_bigrams("p"), _bigrams("r"))}[n]
    return {
        f"gp{n}": f"SELECT {keys}, g, count(*) AS c FROM (SELECT {keys}, unnest({grams[0]}) AS g FROM {source}) GROUP BY ALL",
        f"gr{n}": f"SELECT {keys}, g, count(*) AS c FROM (SELECT {keys}, unnest({grams[1]}) AS g FROM {source}) GROUP BY ALL",
        f"hits{n}": f"SELECT {keys}, sum(least(gp{n}.c, gr{n}.c))::BIGINT AS hits "
        f"FROM gp{n} JOIN gr{n} USING ({keys}, g) GROUP BY {keys}",
    }


def _common_run_ctes(source: str, keys: str) -> dict[str, str]:
    """CTEs giving ``hitsL`` (keys, hits): the longest common subsequences of the columns p and r of tokens.

    Folds over the tokens of p; the state is a list whose k-th entry is the least
    place in r at which a common subsequence of k tokens can end. The places of
    a token put off each entry to the first of them behind the entry before.
    """
    step = "least(T[k], list_min(list_filter(ps, lambda q: q > coalesce(T[k - 1], 0))))"
    fold = f"lambda T, ps: list_filter(list_transform(range(1, len(T) + 2), lambda k: {step}), lambda x: x IS NOT NULL)"
    return {
        "placesL": f"SELECT {keys}, tok, list(i ORDER BY i) AS l FROM (SELECT {keys}, unnest(r) AS tok, generate_subscripts(r, 1) AS i FROM {source}) GROUP BY ALL",
        "matchesL": f"SELECT {keys}, list(l ORDER BY i) AS m FROM (SELECT {keys}, unnest(p) AS tok, generate_subscripts(p, 1) AS i FROM {source}) "
        f"JOIN placesL USING ({keys}, tok) GROUP BY {keys}",
        "hitsL": f"SELECT {keys}, len(list_reduce(list_prepend([]::BIGINT[], m), {fold}))::BIGINT AS hits FROM matchesL",
    }


def _line_ctes() -> dict[str, str]:
    """CTE ``hitsLsum`` (id, hits) of the pairs: lines' common subsequences, united over the prediction's lines and clipped.

    ``ends`` holds for every prefix of a reference line the least places at which
    a common subsequence of 1, 2, ... tokens can end. The walk back drops the
    reference's token unless only dropping the prediction's keeps the length.
    Every place is a token of its own, so clipping by the reference is done.
    """
    lines = lambda c: f"SELECT id, n, {_tokens('line')} AS l FROM (SELECT id, unnest(string_split({c}, chr(10))) AS line, generate_subscripts(string_split({c}, chr(10)), 1) AS n FROM pairs)"
    step = "least(S[-1][k], list_min(list_filter(x[1], lambda q: q > coalesce(S[-1][k - 1], 0))))"
    longer = f"list_filter(list_transform(range(1, len(S[-1]) + 2), lambda k: {step}), lambda y: y IS NOT NULL)"
    spots = "list_transform(r, lambda w: [list_filter(range(1, len(p) + 1), lambda j: p[j] = w)])"
    length = lambda i, j: f"len(list_filter(ends[{i} + 1], lambda y: y <= {j}))"
    walk = f"""CASE WHEN w[1] = 0 OR w[2] = 0 THEN w
        WHEN r[w[1]] = p[w[2]] THEN [w[1] - 1, w[2] - 1] || w[3:] || [w[1]]
        WHEN {length('w[1]', '(w[2] - 1)')} > {length('(w[1] - 1)', 'w[2]')} THEN [w[1], w[2] - 1] || w[3:] ELSE [w[1] - 1, w[2]] || w[3:] END"""
    return {
        "rl": lines("summary"),
        "pl": lines("prediction"),
        "facing": "SELECT rl.id, rl.n, rl.l AS r, pl.l AS p FROM rl JOIN pl ON rl.id = pl.id AND list_has_any(rl.l, pl.l)",
        "ended": f"SELECT *, list_reduce(list_prepend([[]::BIGINT[]], {spots}), lambda S, x: list_append(S, {longer})) AS ends FROM facing",
        "walked": f"SELECT id, n, r, unnest(list_reduce(list_prepend([len(r), len(p)]::BIGINT[], list_transform(range(len(r) + len(p)), lambda k: [k])), lambda w, k: {walk})[3:]) AS i FROM ended",
        "united": "SELECT id, tok, count(*) AS c FROM (SELECT DISTINCT id, n, i, r[i] AS tok FROM walked) GROUP BY ALL",
        "said_p": "SELECT id, tok, count(*) AS c FROM (SELECT id, unnest(l) AS tok FROM pl) GROUP BY ALL",
        "hitsLsum": "SELECT id, sum(least(united.c, said_p.c))::BIGINT AS hits FROM united JOIN said_p USING (id, tok) GROUP BY id",
    }


def _shape(word: str) -> str:
    """A word's letters as v for vowels and c for consonants; y is a vowel after a consonant."""
    return (
        f"list_reduce(list_prepend('', string_split({word}, '')), lambda s, x: s || "
        "CASE WHEN contains('aeiou', x) OR (x = 'y' AND ends_with(s, 'c')) THEN 'v' WHEN x = '' THEN '' ELSE 'c' END)"
    )


def _vowel_runs(word: str) -> str:
    return f"len(regexp_extract_all({_shape(word)}, 'v+c+'))"


def _short_end(word: str) -> str:
    return f"(ends_with({_shape(word)}, 'cvc') AND NOT contains('wxy', right({word}, 1)))"


def _by_suffix(suffixes, then) -> str:
    """``then(suffix, rest)`` of the longest suffix that the word w has, else w."""
    cases = [f"WHEN ends_with(w, '{x}') THEN {then(x, f'left(w, length(w) - {len(x)})')}" for x in sorted(suffixes, key=len, reverse=True)]
    return f"CASE {' '.join(cases)} ELSE w END"


def _stem_ctes(tokens: str) -> dict[str, str]:
    """CTE ``stems`` (tok, stem) of the distinct tokens in ``tokens`` (tok); only tokens of four letters and more change."""

    def past(x: str, rest: str) -> str:
        if x == "eed":
            return f"CASE WHEN {_vowel_runs(rest)} > 0 THEN left(w, length(w) - 1) ELSE w END"
        return f"""CASE WHEN NOT contains({_shape(rest)}, 'v') THEN w WHEN regexp_matches({rest}, '(at|bl|iz)$') THEN {rest} || 'e'
          WHEN length({rest}) > 1 AND right({rest}, 1) = left(right({rest}, 2), 1) AND ends_with({_shape(rest)}, 'c') AND NOT contains('lsz', right({rest}, 1)) THEN left({rest}, length({rest}) - 1)
          WHEN {_vowel_runs(rest)} = 1 AND {_short_end(rest)} THEN {rest} || 'e' ELSE {rest} END"""

    replaced = lambda rules: _by_suffix(rules, lambda x, rest: f"CASE WHEN {_vowel_runs(rest)} > 0 THEN {rest} || '{rules[x]}' ELSE w END")
    strip = lambda x, rest: f"CASE WHEN {'NOT regexp_matches(' + rest + ', ' + repr('[st]$') + ') OR ' if x == 'ion' else ''}{_vowel_runs(rest)} < 2 THEN w ELSE {rest} END"
    cut = "left(w, length(w) - 1)"
    steps = [
        "CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END",
        _by_suffix(("eed", "ed", "ing"), past),
        f"CASE WHEN ends_with(w, 'y') AND contains({_shape(cut)}, 'v') THEN {cut} || 'i' ELSE w END",
        replaced(porter.STEP_2),
        replaced(porter.STEP_3),
        _by_suffix(porter.STEP_4, strip),
        f"CASE WHEN ends_with(w, 'e') AND ({_vowel_runs(cut)} > 1 OR ({_vowel_runs(cut)} = 1 AND NOT {_short_end(cut)})) THEN {cut} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {_vowel_runs(cut)} > 1 THEN {cut} ELSE w END",
    ]
    ctes = {"stem0": f"SELECT DISTINCT tok, tok AS w FROM ({tokens})"}
    for k, step in enumerate(steps):
        ctes[f"stem{k + 1}"] = f"SELECT tok, CASE WHEN length(tok) > 3 THEN {step} ELSE w END AS w FROM stem{k}"
    ctes["stems"] = f"SELECT tok, w AS stem FROM stem{len(steps)}"
    return ctes


_SIZES = {
    "rougeL": ("len(p)", "len(r)"),
    "rougeLsum": ("len(p)", "len(r)"),
    "rouge1": ("len(p)", "len(r)"),
    "rouge2": ("greatest(len(p) - 1, 0)", "greatest(len(r) - 1, 0)"),
}
_HITS = {"rouge1": "hits1", "rouge2": "hits2", "rougeL": "hitsL", "rougeLsum": "hitsLsum"}


def _ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} = 0 THEN 0.0 ELSE ({top})::DOUBLE / ({bottom}) END"


def _f(variant: str) -> str:
    n_pred, n_ref = _SIZES[variant]
    return _ratio(f"2 * coalesce({_HITS[variant]}.hits, 0)", f"({n_pred} + {n_ref})")


def _hit_ctes(variants: tuple[str, ...], source: str, keys: str) -> dict[str, str]:
    ctes: dict[str, str] = {}
    for v in variants:
        ctes |= _common_run_ctes(source, keys) if v == "rougeL" else _gram_hits(source, keys, int(v[-1]))
    return ctes


def _pair_scores(variant: str) -> str:
    toks = {"t": f"SELECT id, {_tokens('prediction')} AS p, {_tokens('summary')} AS r FROM pairs"}
    n_pred, n_ref = _SIZES[variant]
    h = _HITS[variant]
    hits = f"coalesce({h}.hits, 0)"
    body = f"""SELECT id, {hits} AS hits, len(p)::BIGINT AS pred_tokens, len(r)::BIGINT AS ref_tokens,
      round({_ratio(hits, n_pred)}, 6) AS precision, round({_ratio(hits, n_ref)}, 6) AS recall,
      round({_f(variant)}, 6) AS f
    FROM t LEFT JOIN {h} USING (id)"""
    return _with(body, toks | (_line_ctes() if variant == "rougeLsum" else _hit_ctes((variant,), "t", "id")))


def _stemmed_scores(variants: tuple[str, ...]) -> str:
    """Precision, recall and F of every pair's stems."""
    side = lambda c: f"SELECT id, list(stem ORDER BY i) AS l FROM (SELECT id, unnest({c}) AS tok, generate_subscripts({c}, 1) AS i FROM raw) JOIN stems USING (tok) GROUP BY id"
    ctes = {"raw": f"SELECT id, {_tokens('prediction')} AS p, {_tokens('summary')} AS r FROM pairs"}
    ctes |= _stem_ctes("SELECT unnest(p) AS tok FROM raw UNION ALL SELECT unnest(r) FROM raw")
    ctes |= {"ps": side("p"), "rs": side("r"), "t": "SELECT id, coalesce(ps.l, []) AS p, coalesce(rs.l, []) AS r FROM raw LEFT JOIN ps USING (id) LEFT JOIN rs USING (id)"}
    ctes |= _hit_ctes(variants, "t", "id")
    columns = []
    for v in variants:
        n_pred, n_ref = _SIZES[v]
        hits = f"coalesce({_HITS[v]}.hits, 0)"
        columns += [f'round({_ratio(hits, n_pred)}, 6) AS "{v}_precision"', f'round({_ratio(hits, n_ref)}, 6) AS "{v}_recall"', f'round({_f(v)}, 6) AS "{v}_f"']
    joins = " ".join(f"LEFT JOIN {_HITS[v]} USING (id)" for v in variants)
    return _with(f"SELECT id, {', '.join(columns)} FROM t {joins}", ctes)


def _run_scores_ctes(variants: tuple[str, ...], scored: str) -> dict[str, str]:
    """CTE ``run_means``: mean F per run of ``scored`` (run_id, id, prediction, reference)."""
    toks = {"t": f"SELECT run_id, id, {_tokens('prediction')} AS p, {_tokens('reference')} AS r FROM ({scored})"}
    joins = " ".join(f"LEFT JOIN {_HITS[v]} USING (run_id, id)" for v in variants)
    means = ", ".join(f'round(avg({_f(v)}), 6) AS "{v}"' for v in variants)
    ctes = toks | _hit_ctes(variants, "t", "run_id, id")
    return ctes | {"run_means": f"SELECT run_id, {means} FROM t {joins} GROUP BY run_id"}


def _run_means(variants: tuple[str, ...], scored: str, extra: dict[str, str] | None = None) -> str:
    ctes = (extra or {}) | _run_scores_ctes(variants, scored)
    return _with("SELECT * FROM run_means", ctes)


def _known_tokens(column: str, width: int) -> str:
    """The first ``width`` tokens as ids in order, unknown ones as 1."""
    return (
        f"SELECT id, coalesce(list(coalesce(token_id, 1) ORDER BY i) FILTER (WHERE token IS NOT NULL), []) AS ids "
        f"FROM (SELECT id, unnest(CASE WHEN len(s) = 0 THEN [NULL] ELSE s END) AS token, "
        f"unnest(CASE WHEN len(s) = 0 THEN [0] ELSE range(len(s)) END) AS i "
        f"FROM (SELECT id, list_slice({_tokens(column)}, 1, {width}) AS s FROM pairs)) "
        f"LEFT JOIN vocab USING (token) GROUP BY id"
    )


def _padded(ids: str, width: int) -> str:
    return f"array_to_string(list_resize({ids}, {width}, 0), ' ')"


def _mask(ids: str, width: int) -> str:
    return f"array_to_string(list_transform(range({width}), lambda i: CASE WHEN i < len({ids}) THEN 1 ELSE 0 END), ' ')"


def _decoded(column: str, width: int) -> str:
    """(id, text): the first tokens that the vocabulary knows."""
    return (
        f"SELECT id, coalesce(string_agg(vocab.token, ' ' ORDER BY i), '') AS text "
        f"FROM (SELECT id, unnest(CASE WHEN len(s) = 0 THEN [NULL] ELSE s END) AS token, "
        f"unnest(CASE WHEN len(s) = 0 THEN [0] ELSE range(len(s)) END) AS i "
        f"FROM (SELECT id, list_slice({_tokens(column)}, 1, {width}) AS s FROM pairs)) "
        f"LEFT JOIN vocab USING (token) GROUP BY id"
    )


def _cut(text: str, budget: int) -> str:
    """The text up to the end of its ``budget``-th token."""
    pieces = f"regexp_extract_all({text}, '{UP_TO_TOKEN}')"
    return f"CASE WHEN len({pieces}) <= {budget} THEN {text} ELSE array_to_string(list_slice({pieces}, 1, {budget}), '') END"


def _words(text: str, first: int, last: int) -> str:
    return f"array_to_string(list_slice(string_split({text}, ' '), {first}, {last}), ' ')"


_PROMPT = f"'{INSTRUCTION}{TEXT_MARKER}' || text"
_ASK = f"('{INSTRUCTION}' || text)"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_ROUND_BOARD = (
    'SELECT folder AS "Folder", round((rouge1 + rouge2 + "rougeL") / 3, 6) AS "RougeAvg", '
    'round(rouge1, 6) AS "Rouge1", round(rouge2, 6) AS "Rouge2", round("rougeL", 6) AS "RougeL" FROM scores'
)
_ENCODED = {"e": _known_tokens("text", ENC_MAX_LEN)}
_LABELS = {"l": _known_tokens("summary", ENC_MAX_LEN)}


def _causal_ids() -> str:
    """Prompted ids of 256 slots, the last one spelling the marker."""
    prompted = _known_tokens(_PROMPT, 256)
    marker = "(SELECT coalesce(max(token_id), 1) FROM vocab WHERE token = 'summary')"
    body = f"SELECT id, array_to_string(list_concat(list_resize(ids, 255, 0), [{marker}]), ' ') AS input_ids FROM e"
    return _with(body, {"e": prompted})


def _causal_scores() -> str:
    """Answers of the causal stand-in over pubmed's validation split."""
    shown = {
        "prompts": _decoded(_PROMPT, 255),
        "marker": "SELECT coalesce(max(' ' || token), '') AS m FROM vocab WHERE token = 'summary'",
        "answerable": f"SELECT id, text || m || ' {ANSWER_MARKER}' AS prompt FROM prompts, marker",
        "answers": f"""SELECT 'lead-pubmed' AS run_id, id, trim(string_split(prompt || ' ' || {_words('prompt', 1, GEN_MAX_LEN)},
            '{ANSWER_MARKER}')[2], {_BLANKS}) AS prediction FROM answerable""",
    }
    fits = f"len({_tokens(_PROMPT + ' || summary')}) < 2048"
    scored = (
        "SELECT run_id, id, answers.prediction, summary AS reference FROM answers JOIN admitted USING (id) "
        f"WHERE dataset = 'pubmed' AND split = 'validation' AND {fits}"
    )
    return _run_means(("rouge1", "rouge2"), scored, shown)


def _resumed(text: str, source: str) -> str:
    """Two passes over ``text``: the first fails for lengths in fives, the second in 25s."""
    lead = _words(text, 1, GEN_MAX_LEN)
    return f"""SELECT id, CASE WHEN length({text}) % 5 <> 0 THEN 1 ELSE 2 END::INTEGER AS attempt,
        length({text}) % 25 <> 0 AS ok,
        CASE WHEN length({text}) % 5 <> 0 THEN {lead} WHEN length({text}) % 25 <> 0 THEN 'retry ' || {lead} END AS output
      FROM {source}"""


def _intervals(variants: tuple[str, ...], resamples: int, tail: int) -> str:
    """Means of the aligned runs and the bounds of their resampled means."""
    scores = " UNION ALL ".join(f"SELECT run_id, id, '{v}' AS variant, {_f(v)} AS x FROM t LEFT JOIN {_HITS[v]} USING (run_id, id)" for v in variants)
    number = lambda text, below: f"('0x' || substr(md5({text}), 1, 15))::BIGINT % {below}"
    weight = " + ".join(f"(u >= {t})::INT" for t in thresholds())
    toks = {"t": f"SELECT run_id, id, {_tokens('prediction')} AS p, {_tokens('reference')} AS r FROM aligned"}
    ctes = toks | _hit_ctes(variants, "t", "run_id, id") | {
        "scored": f"SELECT *, {number('id::VARCHAR', PRIME)} AS k FROM ({scores})",
        "draws": f"SELECT b, 1 + {number(f"'{SEED}:a:' || b", PRIME - 1)} AS a, {number(f"'{SEED}:c:' || b", PRIME)} AS c FROM range(1, {resamples + 1}) AS x(b)",
        "weighed": f"SELECT run_id, variant, b, x, {weight} AS w FROM (SELECT *, (a * k + c) % {PRIME} AS u FROM scored, draws)",
        "drawn": "SELECT run_id, variant, list_sort(list(m)) AS l FROM (SELECT run_id, variant, b, sum(w * x) / sum(w) AS m FROM weighed "
        "WHERE w > 0 GROUP BY ALL) GROUP BY ALL",
        "plain": "SELECT run_id, variant, avg(x) AS mean FROM scored GROUP BY ALL",
    }
    at = lambda part: f"round(l[greatest(1, (len(l) * {part} + 999) // 1000)], 6)"
    return _with(
        f"SELECT run_id, variant, {at(tail)} AS low, round(mean, 6) AS mean, {at(1000 - tail)} AS high, len(l)::BIGINT AS resamples FROM drawn JOIN plain USING (run_id, variant)",
        ctes,
    )


# Fixed values, as in the splitter: blanks, and what opens and closes a quotation or a bracket.
_WORDS = "regexp_extract_all({}, '[^ \\t\\n\\x0b\\f\\r]+')"
_OPEN, _CLOSE = "[\"''(\\[{«“‘]", "\"'')\\]}»”’"


def _sentence_ctes() -> dict[str, str]:
    """CTEs ``abbreviated`` (word, with_period, without, score) and ``said`` (id, nth, sentence)."""
    texts = f"SELECT id, {_WORDS.format('text')} AS l FROM pairs"
    bare = f"lower(regexp_replace(regexp_replace(w, '[{_CLOSE},;:]+$', ''), '^{_OPEN}+', ''))"
    word = "CASE WHEN ends_with(bare, '.') THEN bare[:-2] ELSE bare END"
    score = (
        "-2 * (with_period * ln(share / 0.99::DOUBLE) + without * ln((1 - share) / (1 - 0.99::DOUBLE))) * exp(-letters) * (length(word) - letters + 1) * pow(letters::DOUBLE, -without)"
    )
    before = f"lower(regexp_replace(regexp_replace(w, '[.!?]+[{_CLOSE}]*$', ''), '^{_OPEN}+', ''))"
    marks = f"regexp_extract(w, '([.!?]+)[{_CLOSE}]*$', 1)"
    return {
        "listed": texts,
        "bared": f"SELECT {bare} AS bare FROM (SELECT unnest(l) AS w FROM listed)",
        "spoken": f"SELECT {word} AS word, ends_with(bare, '.') AS dotted FROM bared",
        "shares": "SELECT count_if(dotted)::DOUBLE / count(*) AS share FROM spoken",
        "counted": "SELECT word, count_if(dotted)::BIGINT AS with_period, count_if(NOT dotted)::BIGINT AS without, length(replace(word, '.', '')) AS letters "
        "FROM spoken WHERE regexp_matches(word, '\\p{L}') AND NOT regexp_matches(word, '[.!?]$') GROUP BY word HAVING count_if(dotted) > 0",
        "abbreviated": f"SELECT word, with_period, without, {score} AS score FROM counted, shares WHERE {score} >= 0.3",
        "spots": "SELECT id, i, w, lead(w) OVER (PARTITION BY id ORDER BY i) AS next FROM (SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM listed)",
        "marked": f"""SELECT id, i, w, {marks} <> '' AND next IS NOT NULL AND NOT regexp_matches(next, '^{_OPEN}*\\p{{Ll}}')
            AND NOT ({marks} = '.' AND ({before} IN (SELECT word FROM abbreviated) OR regexp_full_match({before}, '\\p{{L}}'))) AS last FROM spots""",
        "placed": "SELECT id, i, w, coalesce(sum(last::INT) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS nth FROM marked",
        "said": "SELECT id, nth, string_agg(w, ' ' ORDER BY i) AS sentence FROM placed GROUP BY id, nth",
    }


_LETTERS = "[length(x), ascii(x[1]) % 7 + 1, ascii(x[-1]) % 5 + 1]::FLOAT[]"


def _letter_matches(scored: str) -> dict[str, str]:
    """CTE ``letters``: precision, recall and f per run by vectors of a token's letters.

    ``scored`` has run_id, id and the tokens p and r. Tokens with one vector
    match alike, so each distinct vector is matched once and counted.
    """
    vectors = lambda side: f"SELECT run_id, id, v, count(*) AS n FROM (SELECT run_id, id, unnest(list_transform({side}, lambda x: {_LETTERS})) AS v FROM {scored}) GROUP BY ALL"
    best = lambda a, b: (
        f"SELECT run_id, id, sum(n * best) / sum(n) AS value FROM (SELECT run_id, id, a.v, any_value(a.n) AS n, max(list_cosine_similarity(a.v, b.v)) AS best "
        f"FROM {a} a JOIN {b} b USING (run_id, id) GROUP BY run_id, id, a.v) GROUP BY run_id, id"
    )
    return {
        "pv": vectors("p"), "rv": vectors("r"), "bp": best("pv", "rv"), "br": best("rv", "pv"),
        "matched": f"SELECT run_id, coalesce(bp.value, 0) AS precision, coalesce(br.value, 0) AS recall FROM {scored} LEFT JOIN bp USING (run_id, id) LEFT JOIN br USING (run_id, id)",
        "letters": "SELECT run_id, avg(precision) AS precision, avg(recall) AS recall, avg(CASE WHEN precision + recall = 0 "
        "THEN 0 ELSE 2 * precision * recall / (precision + recall) END) AS f FROM matched GROUP BY run_id",
    }


def _configured(variants: tuple[str, ...]) -> str:
    """The configured evaluation: the first ids of arxiv's test texts, by ROUGE and by letter vectors."""
    name = f"'lead-arxiv-{ENC_MAX_LEN}'"
    scored = (
        f"SELECT {name} AS run_id, id, firsts.text AS prediction, summary AS reference FROM firsts JOIN admitted USING (id) "
        "WHERE dataset = 'arxiv' AND split = 'test'"
    )
    ctes = {"firsts": _decoded("text", GEN_MAX_LEN)} | _run_scores_ctes(variants, scored) | _letter_matches("t")
    rouge = " UNION ALL ".join(f"SELECT run_id, 'rouge' AS metric, '{v}' AS variant, round({v}, 5) AS value FROM run_means" for v in variants)
    letters = " UNION ALL ".join(f"SELECT run_id, 'bertscore', '{c}', round({c}, 5) FROM letters" for c in ("precision", "recall", "f"))
    return _with(f"{rouge} UNION ALL {letters}", ctes)


def oracle_sql() -> dict[str, str]:
    ngrams = ("rouge1", "rouge2")
    out = {
        "corpus_load": "SELECT id, dataset, split, text, summary FROM admitted WHERE dataset = 'arxiv'",
        "corpus_rename": "SELECT id, dataset, split, text, summary FROM pairs",
        "corpus_split": "SELECT id, dataset, split, text, summary FROM pairs WHERE split = 'test'",
        "corpus_source": "SELECT id, dataset, split, text, summary FROM pairs WHERE dataset IN ('arxiv', 'govreport') AND split = 'test'",
        "runs_scan": "SELECT * FROM scores",
        "predlog_scan": "SELECT folder, position, prediction FROM log_items",
        "predlog_route": """
            SELECT CASE WHEN contains(folder, 'arxiv') THEN 'arxiv' WHEN contains(folder, 'pubmed') THEN 'pubmed'
                        ELSE 'govreport' END AS dataset,
              count(DISTINCT folder) AS runs, count(*) AS predictions
            FROM log_items GROUP BY 1""",
        "sink_predictions": "SELECT id, prediction, run_id FROM run_predictions",
        "sink_metrics": "SELECT * FROM scores",
        "sink_leaderboard": _ROUND_BOARD,
        "prompt_prefix": f"SELECT id, {_PROMPT} AS text, summary FROM pairs",
        "chat_messages": f"""
            SELECT id, 'system' AS role, {_cut(_ASK, CHAT_BUDGET)} AS content FROM pairs""",
        "token_budget_truncate": f"SELECT id, {_cut('text', CHAT_BUDGET)} AS text FROM pairs",
        "suffix_reserve": """
            SELECT id, array_to_string(list_concat(list_slice(w, 1, greatest(len(w) - 2, 0)), list_slice(['SUMMARY', ':'], 3 - least(len(w), 2), 2)), ' ') AS ids
            FROM (SELECT id, string_split(text, ' ') AS w FROM pairs)""",
        "answer_extract": f"""
            SELECT id, trim(string_split(o, '{ANSWER_MARKER}')[2], {_BLANKS}) AS answer
            FROM (SELECT id, text || CASE WHEN id % 7 = 0 THEN ' ' ELSE ' SUMMARY:' || chr(10) || ' ' END || prediction
                    || CASE WHEN id % 3 = 0 THEN ' ' || chr(10) || 'SUMMARY: again' ELSE chr(9) || chr(10) END AS o
                  FROM pairs)""",
        "clip_preview": """
            SELECT id, dataset[:10] AS dataset, split[:10] AS split, text[:10] AS text, summary[:10] AS summary,
              prediction[:10] AS prediction FROM pairs""",
        "run_key": """
            SELECT event_id, model || '-' || dataset || '-' || width AS run_key, model || '-' || width || '-' || dataset AS hub_key,
              model || '-' || dataset || '-' || width || '-' || strftime(ts, '%d%m%Y%H%M%S') AS folder
            FROM (SELECT event_id, ts, 'model-' || event_type AS model, 1024 * (event_id % 8 + 1) AS width,
                    (['arxiv','pubmed','govreport','bigpatent'])[user_id % 4 + 1] AS dataset FROM events)""",
        "run_key_parse": """
            SELECT run_id AS folder, count(*) AS n, nullif(regexp_extract(run_id, rx, 1), '') AS model,
              nullif(regexp_extract(run_id, rx, 2), '') AS dataset,
              nullif(regexp_extract(run_id, rx, 3), '')::BIGINT AS enc_max_len,
              try_strptime(nullif(regexp_extract(run_id, rx, 4), ''), '%d%m%Y%H%M%S') AS started
            FROM run_predictions,
              (SELECT '^(.+?)-(arxiv|pubmed|govreport|bigpatent)(?:-([0-9]+)-([0-9]{14}))?$' AS rx)
            GROUP BY run_id, rx""",
        "token_count": f"""
            SELECT id, dataset, split, len({_tokens('text')})::BIGINT AS text_tokens,
              len({_tokens('summary')})::BIGINT AS summary_tokens FROM pairs""",
        "preview_head": """
            SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY split ORDER BY id) <= 4""",
        "train_cap": """
            SELECT * FROM pairs
            QUALIFY split <> 'train' OR row_number() OVER (PARTITION BY split ORDER BY id) <= 100""",
        "admission_filter": "SELECT id, dataset, split, text, summary FROM admitted",
        "context_window_filter": f"""
            SELECT id, {_PROMPT} AS text, summary FROM pairs
            WHERE len({_tokens(_PROMPT + ' || summary')}) < 1024 // 3""",
        "length_cutoff": "SELECT id, num_tok FROM prompt_lengths WHERE num_tok < 18000",
        "failed_subset": """
            SELECT id, text FROM pairs WHERE id IN (SELECT id FROM attempts WHERE attempt = 1 AND NOT ok)""",
        "pending_subset": "SELECT id, text FROM pairs WHERE id NOT IN (SELECT id FROM attempts WHERE ok)",
        "sample_one": """
            SELECT dataset, id, text, summary FROM pairs
            QUALIFY row_number() OVER (PARTITION BY dataset
              ORDER BY substring(md5(CAST(id AS VARCHAR) || 'reading'), 1, 15), id) = 1""",
        "align_pairs": "SELECT run_id, id, prediction, reference FROM aligned",
        "retry_merge": """
            SELECT id, attempt, ok, output FROM pairs LEFT JOIN attempts USING (id)
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY ok DESC, attempt DESC) = 1""",
        "side_by_side": """
            SELECT p.id, p.dataset, p.text, p.summary, coalesce(a.prediction, '{Summary missing}') AS "lead-3.5-turbo",
              coalesce(b.prediction, '{Summary missing}') AS skip, coalesce(c.prediction, '{Summary missing}') AS echo
            FROM pairs p
            LEFT JOIN run_predictions a ON a.id = p.id AND starts_with(a.run_id, 'lead-')
            LEFT JOIN run_predictions b ON b.id = p.id AND starts_with(b.run_id, 'skip-')
            LEFT JOIN run_predictions c ON c.id = p.id AND starts_with(c.run_id, 'echo-')""",
        "admission_audit": """
            SELECT dataset, split, count(*) AS rows_in, count(reason) AS rows_dropped,
              round(100 * count(reason) / count(*), 6) AS percent_dropped,
              count(*) FILTER (WHERE reason = 'null') AS n_null, count(*) FILTER (WHERE reason = 'empty') AS n_empty,
              count(*) FILTER (WHERE reason = 'too_short_ratio') AS n_too_short_ratio,
              count(*) FILTER (WHERE reason = 'too_long_ratio') AS n_too_long_ratio,
              count(*) FILTER (WHERE reason = 'verbatim') AS n_verbatim,
              count(*) FILTER (WHERE reason = 'below_min') AS n_below_min
            FROM (SELECT dataset, split, CASE
                    WHEN text IS NULL OR summary IS NULL THEN 'null' WHEN summary = '' THEN 'empty'
                    WHEN length(text) <= 2 * length(summary) THEN 'too_short_ratio'
                    WHEN length(text) >= 1000 * length(summary) THEN 'too_long_ratio'
                    WHEN contains(text, summary) THEN 'verbatim' WHEN length(text) < 100 THEN 'below_min' END AS reason
                  FROM pairs)
            GROUP BY dataset, split""",
        "length_histogram": """
            SELECT num_tok // 10 * 10 AS bin_start, count(*) AS n FROM prompt_lengths GROUP BY 1""",
        "length_summary": """
            SELECT max(num_tok) AS longest, min(num_tok) AS shortest, round(avg(num_tok), 6) AS average
            FROM prompt_lengths""",
        "length_summary_by_corpus": f"""
            SELECT dataset, split, max(n) AS longest, min(n) AS shortest, round(avg(n), 6) AS average
            FROM (SELECT dataset, split, len({_tokens('text')})::BIGINT AS n FROM corpora) GROUP BY ALL""",
        "length_top_by_corpus": f"""
            SELECT dataset, summary_tokens, count(*) AS n
            FROM (SELECT dataset, len({_tokens('summary')})::BIGINT AS summary_tokens FROM corpora) GROUP BY dataset, summary_tokens
            QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, summary_tokens) <= 20""",
        "hook_tokenizer": """
            SELECT id, len(regexp_extract_all(text, '[^ ]+'))::BIGINT AS n,
              CASE WHEN len(regexp_extract_all(text, '[^ ]+')) <= 100 THEN text
                ELSE array_to_string(list_slice(regexp_extract_all(text, '[ ]*[^ ]+'), 1, 100), '') END AS text FROM pairs""",
        "align_corpora": """
            SELECT 'run' AS run_id, dataset, id, p.prediction, r.summary AS reference
            FROM corpora p JOIN corpora r USING (dataset, id)""",
        "length_top": """
            SELECT num_tok, count(*) AS n FROM prompt_lengths GROUP BY 1 ORDER BY n DESC, num_tok LIMIT 20""",
        "length_by_side": f"""
            SELECT side, max(n) AS longest, min(n) AS shortest, round(avg(n), 6) AS average
            FROM (SELECT 'text' AS side, len({_tokens('text')})::BIGINT AS n FROM pairs
                  UNION ALL SELECT 'summary', len({_tokens('summary')})::BIGINT FROM pairs)
            GROUP BY side""",
        "rouge_avg": 'SELECT folder AS "Folder", round((rouge1 + rouge2 + "rougeL") / 3, 6) AS "RougeAvg" FROM scores',
        "rouge_geo_mean": """
            SELECT folder AS "Folder", round(pow(rouge1 * rouge2 * "rougeL", 1.0 / 3.0) * 100, 6) AS geo_mean,
              round(rouge1 * 100, 6) AS "Rouge1", round(rouge2 * 100, 6) AS "Rouge2", round("rougeL" * 100, 6) AS "RougeL"
            FROM scores""",
        "leaderboard": _ROUND_BOARD + " ORDER BY folder",
        "best_checkpoint": """
            SELECT run_id, step, eval_rouge1 FROM eval_log
            QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY eval_rouge1 DESC, step) = 1""",
        "vocab_build": "SELECT token, n, token_id FROM vocab",
        "decode_subword": "SELECT id, text FROM pairs",
        "generate_batched": f"SELECT id, {_words('text', 1, GEN_MAX_LEN)} AS prediction FROM pairs",
        "generate_resumable": _resumed("text", "pairs"),
        "bertscore_pair": """
            SELECT pair_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f, 6) AS f FROM bert""",
        "bertscore_corpus": """
            SELECT 'vectors-' || (pair_id % 3) AS run_id, round(avg(precision), 6) AS precision,
              round(avg(recall), 6) AS recall, round(avg(f), 6) AS f FROM bert GROUP BY 1""",
        "hook_preprocess": """
            SELECT id, dataset, split, text, replace(summary, ' ', '_') AS summary FROM pairs
            WHERE dataset = 'bigpatent' AND length(summary) < 200""",
        "hook_metric": """
            SELECT run_id, 'shared_words' AS metric, 'rate' AS variant,
              round(avg(len(list_intersect(list_distinct(p), list_distinct(r)))::DOUBLE / len(list_distinct(p))), 6) AS value
            FROM (SELECT run_id, string_split(prediction, ' ') AS p, string_split(reference, ' ') AS r FROM aligned)
            GROUP BY run_id""",
        "hook_map_rows": """
            SELECT id, string_split(text, chr(10))[1] AS headline,
              length(string_split(text, chr(10))[1])::BIGINT AS line_chars FROM pairs""",
        "hook_map_batches": """
            SELECT id, unnest(range(len(l))) AS nth, unnest(l) AS line
            FROM (SELECT id, string_split(text, chr(10)) AS l FROM pairs)""",
        "hook_predictor": f"SELECT id, {_words('text', -GEN_MAX_LEN, -1)} AS prediction FROM pairs",
    }
    out = {name: _with(sql.strip()) for name, sql in out.items()}
    answered = {"answered": "SELECT id FROM run_predictions WHERE starts_with(run_id, 'skip-')"}
    counts = """
        SELECT (SELECT count(*) FROM answered JOIN admitted USING (id)) AS matched_predictions,
          (SELECT count(*) FROM answered ANTI JOIN admitted USING (id)) AS predictions_without_reference,
          (SELECT count(*) FROM admitted ANTI JOIN answered USING (id)) AS references_without_prediction"""
    out["align_report"] = _with(counts.strip(), answered)
    out |= {
        "encode_fixed": _with(
            f"SELECT id, {_padded('ids', ENC_MAX_LEN)} AS input_ids, {_mask('ids', ENC_MAX_LEN)} AS attention_mask FROM e",
            _ENCODED,
        ),
        "encode_pairs": _with(
            f"SELECT id, {_padded('e.ids', ENC_MAX_LEN)} AS input_ids, {_mask('e.ids', ENC_MAX_LEN)} AS attention_mask, "
            f"{_padded('l.ids', ENC_MAX_LEN)} AS labels FROM e JOIN l USING (id)",
            _ENCODED | _LABELS,
        ),
        "decode_ids": _with(_decoded("text", ENC_MAX_LEN)),
        "unmask_labels": _with(_decoded("summary", ENC_MAX_LEN)),
        "causal_prompt_ids": _causal_ids(),
        "causal_run": _causal_scores(),
        "rouge1": _pair_scores("rouge1"),
        "rouge2": _pair_scores("rouge2"),
        "rougeL": _pair_scores("rougeL"),
        "rougeLsum": _pair_scores("rougeLsum"),
        "masked_eval": _run_means(
            ngrams,
            "SELECT 'step' AS run_id, id, prediction, decoded.text AS reference FROM pairs JOIN decoded USING (id)",
            {"decoded": _decoded("summary", ENC_MAX_LEN)},
        ),
        "evaluate_run": _run_means(
            ngrams,
            f"SELECT 'lead-arxiv' AS run_id, id, {_words('inputs.text', 1, GEN_MAX_LEN)} AS prediction, "
            f"summary AS reference FROM admitted JOIN inputs USING (id) WHERE dataset = 'arxiv' AND split = 'test'",
            {"inputs": _decoded("text", ENC_MAX_LEN)},
        ),
    }
    asked = f"SELECT id, {_cut(_ASK, CHAT_BUDGET)} AS asked FROM pairs"
    asks = {"asks": asked, "resumed": _resumed("asked", "asks")}
    mine = "FROM resumed JOIN admitted USING (id) WHERE dataset = 'govreport' AND split = 'test'"
    answered = f"SELECT 'chat-govreport' AS run_id, id, output AS prediction, summary AS reference {mine} AND ok"
    out["chat_run"] = _with(
        f"SELECT *, (SELECT count_if(ok) {mine})::BIGINT AS scored, (SELECT count_if(NOT ok) {mine})::BIGINT AS unanswered FROM run_means",
        asks | _run_scores_ctes(ngrams, answered),
    )
    out["rouge_stemmed"] = _stemmed_scores(UNSTEMMED)
    out["rouge_corpus"] = _run_means(UNSTEMMED, "SELECT * FROM aligned")
    out["rouge_corpus_ngrams"] = _run_means(ngrams, "SELECT * FROM aligned")
    out["encode_corpora"] = _with(
        f"SELECT dataset, id, {_padded('ids', ENC_MAX_LEN)} AS input_ids FROM (SELECT dataset, pairs.id // 4 AS id, e.ids "
        "FROM pairs JOIN e USING (id))",
        _ENCODED,
    )
    out["abbreviations"] = _with("SELECT word, with_period, without, round(score, 4) AS score FROM abbreviated", _sentence_ctes())
    out["sentence_split"] = _with("SELECT id, nth, sentence FROM said", _sentence_ctes())
    out["sink_rewrite"] = _with(
        """SELECT id, prediction, run_id FROM run_predictions WHERE NOT starts_with(run_id, 'echo-')
        UNION ALL SELECT id, 'again ' || prediction, run_id FROM run_predictions WHERE starts_with(run_id, 'echo-') AND id % 3 = 0"""
    )
    report = {
        "known": "SELECT dataset, count(*) AS \"references\" FROM pairs GROUP BY dataset",
        "placed": "SELECT run_id, p.dataset, count(*) AS outputs FROM run_predictions JOIN pairs p USING (id) GROUP BY ALL",
        "sized": 'SELECT run_id, dataset, outputs, "references", outputs = "references" AS aligned FROM placed JOIN known USING (dataset)',
    }
    out["position_report"] = _with("SELECT * FROM sized", report)
    out["align_positions"] = _with(
        "SELECT run_id, p.dataset, id, r.prediction, p.summary AS reference FROM run_predictions r JOIN pairs p USING (id) JOIN sized USING (run_id) WHERE aligned", report
    )
    mine = "dataset = 'pubmed' AND split = 'train'"
    out["evaluate_counts"] = _with(
        f"""SELECT 'patchy-pubmed' AS run_id, count(*) AS admitted, count(*) AS predicted, count_if(length(inputs.text) % 7 = 0)::BIGINT AS unanswered,
          count(*) AS matched, 0::BIGINT AS unmatched FROM admitted JOIN inputs USING (id) WHERE {mine}""",
        {"inputs": _decoded("text", 64)},
    )
    out["evaluate_config"] = _configured(ngrams)
    out["rouge_interval"] = _intervals(ngrams, 1000, 25)
    spelled = {"spelled": f"SELECT 'letters-' || (id % 5) AS run_id, id, {_tokens('prediction')} AS p, {_tokens('summary')} AS r FROM pairs"}
    each = " UNION ALL ".join(f"SELECT run_id, '{c}' AS variant, round({c}, 5) AS value FROM letters" for c in ("precision", "recall", "f"))
    out["bertscore_texts"] = _with(each, spelled | _letter_matches("spelled"))
    ctes = _run_scores_ctes(ngrams, "SELECT * FROM aligned")
    out["multi_metric_report"] = _with(
        """SELECT run_id, 'rouge' AS metric, 'rouge1' AS variant, rouge1 AS value FROM run_means
        UNION ALL SELECT run_id, 'rouge', 'rouge2', rouge2 FROM run_means
        UNION ALL SELECT 'vectors-' || (pair_id % 3), 'bertscore', 'precision', round(avg(precision), 6) FROM bert GROUP BY 1
        UNION ALL SELECT 'vectors-' || (pair_id % 3), 'bertscore', 'recall', round(avg(recall), 6) FROM bert GROUP BY 1
        UNION ALL SELECT 'vectors-' || (pair_id % 3), 'bertscore', 'f', round(avg(f), 6) FROM bert GROUP BY 1""",
        ctes,
    )
    return out

