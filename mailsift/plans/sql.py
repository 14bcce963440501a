"""DuckDB text of the oracle: the fixture views and one SQL expression per
Column function. Independent formulations (RE2 has no look-around, so the
label rule uses capture groups; term counts use unnest + GROUP BY)."""

from __future__ import annotations

from ..functions import constants as K

FIXTURE_CTES = r"""
corpus AS (
  SELECT d.doc_id AS row_id, CAST(d.doc_id % 5 AS INT) AS source_rank,
         CASE d.doc_id % 5 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma'
                           WHEN 3 THEN 'delta' ELSE 'epsilon' END AS source,
         CASE WHEN l.toxic IS NULL THEN NULL
              WHEN d.doc_id % 5 = 0 THEN CASE WHEN l.toxic = 1 THEN ' Spam' ELSE 'ham ' END
              WHEN d.doc_id % 5 = 1 THEN CASE WHEN l.toxic = 1 THEN '1' ELSE '0' END
              WHEN d.doc_id % 5 = 2 THEN CASE WHEN l.toxic = 1 THEN 'Phishing Email' ELSE 'Safe Email' END
              WHEN d.doc_id % 5 = 3 THEN CASE WHEN l.toxic = 1 THEN 'phishing' ELSE 'BENIGN' END
              ELSE CASE WHEN l.toxic = 1 THEN 'PHISHING' ELSE 'safe' END END AS raw_label,
         CASE d.n_chars % 7
              WHEN 0 THEN concat(d.text, ' URGENT! verify now at http://www.secure.example.com')
              WHEN 1 THEN concat('Subject:Re ', d.text)
              WHEN 2 THEN concat('Invoice payment card!!!! ', d.text)
              WHEN 3 THEN concat(d.text, ' HTTPS://portal.example.org login')
              ELSE d.text END AS raw_text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
mail AS (
  SELECT d.doc_id + 1 AS uid,
         CASE d.doc_id % 4
              WHEN 0 THEN concat('Desk <U', CAST(d.doc_id AS VARCHAR), '@Mail', CAST(d.doc_id % 10 AS VARCHAR), '.Example.com>')
              WHEN 1 THEN concat(' user', CAST(d.doc_id AS VARCHAR), '@sub.example.net ')
              WHEN 2 THEN 'no at sign' ELSE NULL END AS sender,
         CASE WHEN d.doc_id % 9 = 0 THEN '' ELSE concat_ws(' ', 'Note of', d.source, d.lang) END AS subject,
         d.text AS body
  FROM documents d
),
trusted AS (
  SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS domain FROM pages
  UNION SELECT 'example.net' AS domain
)"""

WS = r"[\s\x{0B}\x{1c}-\x{1f}\x{85}\p{Z}]+"
WORD = r"[\p{L}\p{N}_]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


def clean_text(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '{WS}', ' ', 'g')"
    for label in ("subject", "from", "body"):
        t = f"regexp_replace({t}, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){label}:({WORD})', '\\1 \\2', 'g')"
    return f"lower(trim({t}, ' '))"


def normalise_label(x: str) -> str:
    raw = "coalesce(CAST(" + x + " AS VARCHAR), '')"
    v = f"lower({strip_ws(raw)})"
    whens = " ".join(f"WHEN {q(raw_)} THEN {q(cls)}" for raw_, cls in K.LABEL_SYNONYMS.items())
    return f"(CASE {v} {whens} ELSE {v} END)"


def strip_html(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({t}, '{WS}', ' ', 'g'), ' ')"


def link_count(x: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({x}, ''), '(?i)http[s]?://|www\\.')) AS INT)"


def has_any(x: str, words) -> str:
    t = f"lower(coalesce({x}, ''))"
    return "CAST((" + " OR ".join(f"contains({t}, {q(w)})" for w in words) + ") AS INT)"


def exclamation_count(x: str) -> str:
    t = f"coalesce({x}, '')"
    return f"CAST(length({t}) - length(replace({t}, '!', '')) AS INT)"


def uppercase_ratio(x: str) -> str:
    t = f"coalesce({x}, '')"
    letters = f"len(regexp_extract_all({t}, '\\p{{L}}'))"
    upper = f"len(regexp_extract_all({t}, '\\p{{Lu}}'))"
    return f"(CASE WHEN {letters} > 0 THEN CAST({upper} AS DOUBLE) / {letters} ELSE 0.0 END)"


def features(x: str, prefix: str = "") -> str:
    """The six engineered features as separate columns."""
    return ", ".join([
        f"{link_count(x)} AS {prefix}link_count",
        f"{has_any(x, K.URGENT_WORDS)} AS {prefix}has_urgent_words",
        f"{has_any(x, K.ACCOUNT_WORDS)} AS {prefix}has_account_words",
        f"{has_any(x, K.PAYMENT_WORDS)} AS {prefix}has_payment_words",
        f"{exclamation_count(x)} AS {prefix}exclamation_count",
        f"{uppercase_ratio(x)} AS {prefix}uppercase_ratio",
    ])


def sender_domain(x: str) -> str:
    s = "lower(" + strip_ws("coalesce(" + x + ", '')") + ")"
    lt, gt = f"instr({s}, '<')", f"instr({s}, '>')"
    inner = strip_ws(f"substring({s}, {lt} + 1, greatest({gt} - {lt} - 1, 0))")
    addr = f"(CASE WHEN {lt} > 0 AND {gt} > 0 THEN {inner} ELSE {s} END)"
    last = strip_ws("split_part(" + addr + ", '@', -1)")
    return f"(CASE WHEN instr({addr}, '@') > 0 THEN {last} ELSE '' END)"


def base_domain(x: str) -> str:
    parts = f"string_split(coalesce({x}, ''), '.')"
    return f"(CASE WHEN len({parts}) >= 2 THEN array_to_string({parts}[-2:], '.') ELSE coalesce({x}, '') END)"


def serving_text(subject: str, sender: str, body: str) -> str:
    f = lambda c: strip_ws(f"coalesce({c}, '')")
    return strip_ws(f"concat('Subject: ', {f(subject)}, chr(10) || 'From: ', {f(sender)}, chr(10) || 'Body: ', {f(body)})")


def stop_list() -> str:
    return "[" + ", ".join(q(w) for w in sorted(set(K.ENGLISH_STOP_WORDS))) + "]"


def clean_corpus_cte(passes: int = 2) -> str:
    """valid: cleaned + normalised + valid rows; dedup: first per (text, label)."""
    t = "raw_text"
    for _ in range(passes):
        t = clean_text(t)
    return f"""
cleaned AS (
  SELECT row_id, source_rank, source, {t} AS text, {normalise_label('raw_label')} AS label FROM corpus
),
valid AS (SELECT * FROM cleaned WHERE text <> '' AND label IN ('legitimate', 'phishing')),
dedup AS (
  SELECT row_id, source_rank, source, text, label FROM (
    SELECT *, row_number() OVER (PARTITION BY text, label ORDER BY source_rank, row_id) AS rn FROM valid
  ) WHERE rn = 1
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in (FIXTURE_CTES,) + ctes) + "\n"


# ------------------------------------------------------------ text model

def tf_cte(name: str, docs: str, text: str = "text") -> str:
    """name(row_id, term, tf) for the documents of relation `docs`."""
    return f"""
{name}_toks AS (SELECT row_id, list_filter(regexp_extract_all(lower({text}), '{WORD}{{2,}}'),
                    lambda x: NOT list_contains({stop_list()}, x)) AS f FROM {docs}),
{name}_grams AS (SELECT row_id, list_concat(f, list_transform(range(1, len(f)), lambda i: f[i] || ' ' || f[i + 1])) AS g
                 FROM {name}_toks),
{name} AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(g) AS term FROM {name}_grams)
           GROUP BY row_id, term)"""


def vocab_cte(tf: str, docs: str, max_features: int = K.MAX_FEATURES, min_df: int = K.MIN_DF) -> str:
    return f"""
vstats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS corpus_tf FROM {tf} GROUP BY term HAVING count(*) >= {min_df}),
vtop AS (SELECT * FROM vstats ORDER BY corpus_tf DESC, term LIMIT {max_features}),
vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS term_ix, df, corpus_tf,
                 ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf
          FROM vtop, (SELECT count(*) AS n FROM {docs}) nd)"""


def tfidf_cte(name: str, tf: str, sublinear: bool = True) -> str:
    """name(row_id, ix, w): (sublinear) tf x idf, L2-normalised per document."""
    weight = "(1.0 + ln(t.tf))" if sublinear else "CAST(t.tf AS DOUBLE)"
    return f"""
{name}_raw AS (SELECT t.row_id, v.term_ix AS ix, {weight} * v.idf AS raw FROM {tf} t JOIN vocab v ON t.term = v.term),
{name} AS (SELECT row_id, ix, raw / sqrt(sum(raw * raw) OVER (PARTITION BY row_id)) AS w FROM {name}_raw)"""


def engineered_pairs_cte(name: str, docs: str, text: str = "text") -> str:
    """name(row_id, ix, w): non-zero engineered features at ix = V + k."""
    cols = [Q_FEATURE(text, f) for f in K.ENGINEERED_FEATURES]
    selects = " UNION ALL ".join(
        f"SELECT row_id, CAST((SELECT count(*) FROM vocab) + {k} AS INT) AS ix, CAST({expr} AS DOUBLE) AS w FROM {docs}"
        for k, expr in enumerate(cols))
    return f"""
{name}_all AS ({selects}),
{name} AS (SELECT * FROM {name}_all WHERE w <> 0)"""


def Q_FEATURE(text: str, name: str) -> str:
    return {
        "link_count": link_count(text),
        "has_urgent_words": has_any(text, K.URGENT_WORDS),
        "has_account_words": has_any(text, K.ACCOUNT_WORDS),
        "has_payment_words": has_any(text, K.PAYMENT_WORDS),
        "exclamation_count": exclamation_count(text),
        "uppercase_ratio": uppercase_ratio(text),
    }[name]


def split_cte(source: str = "dedup", seed: int = K.SPLIT_SEED, test_size: float = K.TEST_FRACTION) -> str:
    """parts(row_id, label, part) with exact per-class quotas."""
    return f"""
s_counts AS (SELECT label, count(*) AS n_c FROM {source} GROUP BY label),
s_tot AS (SELECT sum(n_c) AS n, CAST(ceil(CAST({test_size} AS DOUBLE) * sum(n_c)) AS BIGINT) AS n_test FROM s_counts),
s_base AS (SELECT label, n_c, ((n - n_test) * n_c) // n AS fl, ((n - n_test) * n_c) % n AS rem, n, n_test
           FROM s_counts, s_tot),
s_alloc AS (SELECT label, n_c, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
                                          <= (n - n_test) - sum(fl) OVER () THEN 1 ELSE 0 END AS train_c FROM s_base),
s_rank AS (SELECT d.row_id, d.label, row_number() OVER (PARTITION BY d.label
              ORDER BY substr(md5(CAST(d.row_id AS VARCHAR) || ':{seed}'), 1, 15), d.row_id) AS rk FROM {source} d),
parts AS (SELECT r.row_id, r.label, CASE WHEN r.rk <= a.n_c - a.train_c THEN 'test' ELSE 'train' END AS part
          FROM s_rank r JOIN s_alloc a ON r.label = a.label),
train AS (SELECT d.* FROM {source} d JOIN parts p ON d.row_id = p.row_id WHERE p.part = 'train'),
test AS (SELECT d.* FROM {source} d JOIN parts p ON d.row_id = p.row_id WHERE p.part = 'test')"""


def nb_cte(train: str = "train", alpha: float = 1.0, engineered: bool = True) -> str:
    """coef(ix, coefficient) and prior(intercept) of multinomial NB on `train`
    using the feature pairs relation `feats` (row_id, ix, w)."""
    more = f"""
         UNION ALL SELECT CAST((SELECT count(*) FROM vocab) + k AS INT), name
         FROM (VALUES {", ".join(f"({k}, {q(nm)})" for k, nm in enumerate(K.ENGINEERED_FEATURES))}) e(k, name)"""
    return f"""
nf AS (SELECT count(*) + {len(K.ENGINEERED_FEATURES) if engineered else 0} AS n_features FROM vocab),
grid AS (SELECT term_ix AS ix, term AS feature FROM vocab{more if engineered else ""}),
fc AS (SELECT t.label, f.ix, sum(f.w) AS total FROM feats f JOIN {train} t ON f.row_id = t.row_id GROUP BY t.label, f.ix),
ctot AS (SELECT label, sum(total) AS total FROM fc GROUP BY label),
flp AS (SELECT c.label, g.ix, ln((coalesce(fc.total, 0) + {alpha}) / (ct.total + {alpha} * nf.n_features)) AS lp
        FROM grid g CROSS JOIN (VALUES ('legitimate'), ('phishing')) c(label)
        JOIN ctot ct ON ct.label = c.label CROSS JOIN nf
        LEFT JOIN fc ON fc.label = c.label AND fc.ix = g.ix),
coef AS (SELECT g.ix, g.feature, p.lp - l.lp AS coefficient FROM grid g
         JOIN flp p ON p.ix = g.ix AND p.label = 'phishing' JOIN flp l ON l.ix = g.ix AND l.label = 'legitimate'),
prior AS (SELECT ln(sum(CASE WHEN label = 'phishing' THEN 1 ELSE 0 END))
               - ln(sum(CASE WHEN label = 'legitimate' THEN 1 ELSE 0 END)) AS intercept FROM {train})"""


def scores_cte(docs: str = "test") -> str:
    """scored(row_id, actual, margin, predicted, phishing_confidence)."""
    return f"""
margins AS (SELECT d.row_id, d.label AS actual,
                   coalesce(sum(f.w * c.coefficient), 0) + (SELECT intercept FROM prior) AS margin
            FROM {docs} d LEFT JOIN feats f ON f.row_id = d.row_id LEFT JOIN coef c ON c.ix = f.ix
            GROUP BY d.row_id, d.label),
scored AS (SELECT row_id, actual, margin,
                  CASE WHEN margin > 0 THEN 'phishing' ELSE 'legitimate' END AS predicted,
                  1.0 / (1.0 + exp(-margin)) AS phishing_confidence FROM margins)"""


def text_model_ctes(source: str = "dedup", max_features: int = K.MAX_FEATURES, min_df: int = K.MIN_DF,
                    sublinear: bool = True, engineered: bool = True) -> list[str]:
    """split -> vocabulary on train -> tfidf + engineered pairs for all docs
    (feats) -> NB -> scores on test."""
    feats = "feats AS (SELECT * FROM tfidf UNION ALL SELECT * FROM eng)" if engineered else "feats AS (SELECT * FROM tfidf)"
    return [split_cte(source), tf_cte("tf_train", "train"), vocab_cte("tf_train", "train", max_features, min_df),
            tf_cte("tf_all", source), tfidf_cte("tfidf", "tf_all", sublinear), engineered_pairs_cte("eng", source),
            feats, nb_cte("train", engineered=engineered), scores_cte("test")]


def margins_cte(name: str, docs: str, feats: str, label_col: str | None = "label") -> str:
    lab = f", d.{label_col} AS actual" if label_col else ""
    grp = f", d.{label_col}" if label_col else ""
    return f"""
{name} AS (SELECT d.row_id{lab}, coalesce(sum(f.w * c.coefficient), 0) + (SELECT intercept FROM prior) AS margin
           FROM {docs} d LEFT JOIN {feats} f ON f.row_id = d.row_id LEFT JOIN coef c ON c.ix = f.ix
           GROUP BY d.row_id{grp})"""


def attributions_cte(name: str, feats: str, preds: str) -> str:
    """name(row_id, rk, feature, weight): top 6 of coef * x toward the prediction."""
    return f"""
{name}_c AS (SELECT f.row_id, f.ix, f.w * c.coefficient AS c,
                    CASE WHEN p.predicted = 'legitimate' THEN -1.0 ELSE 1.0 END AS sgn
             FROM {feats} f JOIN coef c ON c.ix = f.ix JOIN {preds} p ON p.row_id = f.row_id),
{name}_r AS (SELECT row_id, ix, round(c * sgn, 4) AS weight,
                    row_number() OVER (PARTITION BY row_id ORDER BY abs(round(c, 4)) DESC, ix) AS rk
             FROM {name}_c WHERE abs(c) >= {K.ATTRIBUTION_EPS}),
{name} AS (SELECT r.row_id, r.rk, g.feature, r.weight FROM {name}_r r JOIN grid g ON g.ix = r.ix WHERE r.rk <= {K.ATTRIBUTION_TOP})"""


def sentence_expr(attr: str, preds: str) -> str:
    """Linear-attribution sentence per row of `preds` (row_id, predicted)."""
    from ..functions.scores import LINEAR_SENTENCES as S
    (pl, pf), (ll, lf) = S["phishing"], S["legitimate"]
    names = (f"(SELECT string_agg(feature, ', ' ORDER BY rk) FROM (SELECT feature, rk FROM {attr} a "
             f"WHERE a.row_id = p.row_id AND a.weight > 0 ORDER BY rk LIMIT {K.SENTENCE_TOP}))")
    return (f"CASE WHEN p.predicted = 'phishing' THEN CASE WHEN {names} IS NULL THEN {q(pf)} ELSE {q(pl)} || {names} || '.' END "
            f"ELSE CASE WHEN {names} IS NULL THEN {q(lf)} ELSE {q(ll)} || {names} || '.' END END")


def mail_ctes() -> list[str]:
    """Mail messages through the fixture model: mail_scored(row_id, sender, ctext,
    sd, bd, margin, predicted, trusted) + mail_attr."""
    return [f"""
mail_docs AS (SELECT uid AS row_id, sender, {clean_text(serving_text('subject', 'sender', 'body'))} AS ctext,
                     {sender_domain('sender')} AS sd FROM mail),
mail_clean AS (SELECT *, {base_domain('sd')} AS bd FROM mail_docs)""",
            tf_cte("tf_mail", "mail_clean", "ctext"), tfidf_cte("mtfidf", "tf_mail"),
            engineered_pairs_cte("meng", "mail_clean", "ctext"),
            "mfeats AS (SELECT * FROM mtfidf UNION ALL SELECT * FROM meng)",
            margins_cte("mail_m", "mail_clean", "mfeats", None),
            """
tset AS (SELECT DISTINCT domain FROM trusted WHERE domain IS NOT NULL AND domain <> ''),
mail_scored AS (SELECT c.*, m.margin, CASE WHEN m.margin > 0 THEN 'phishing' ELSE 'legitimate' END AS predicted,
                       (c.sd IN (SELECT domain FROM tset) OR c.bd IN (SELECT domain FROM tset)) AS trusted
                FROM mail_clean c JOIN mail_m m ON m.row_id = c.row_id)""",
            attributions_cte("mail_attr", "mfeats", "mail_scored")]


def reasons_expr(t: str = "ctext") -> str:
    """Rule reasons joined by ' | ' (display features on the cleaned text)."""
    ph = [("NOT trusted", K.REASON_UNTRUSTED), (f"{link_count(t)} > 0", K.REASON_LINKS),
          (f"{has_any(t, K.URGENT_WORDS)} = 1", K.REASON_URGENT), (f"{has_any(t, K.ACCOUNT_WORDS)} = 1", K.REASON_ACCOUNT),
          (f"{has_any(t, K.PAYMENT_WORDS)} = 1", K.REASON_PAYMENT),
          (f"{exclamation_count(t)} > {K.EXCLAMATION_LIMIT}", K.REASON_EXCLAIM),
          (f"round({uppercase_ratio(t)}, 4) > {K.UPPERCASE_LIMIT}", K.REASON_UPPER)]
    parts = "concat_ws(' | ', " + ", ".join(f"CASE WHEN {c} THEN {q(r)} END" for c, r in ph) + ")"
    phish = f"CASE WHEN {parts} = '' THEN {q(K.REASON_FALLBACK)} ELSE {parts} END"
    legit = (f"concat_ws(' | ', {q(K.REASON_NO_INDICATORS)}, CASE WHEN trusted THEN {q(K.REASON_TRUSTED)} END, "
             f"{q(K.REASON_SAFE_LANGUAGE)})")
    return f"(CASE WHEN predicted = 'phishing' THEN {phish} ELSE {legit} END)"
