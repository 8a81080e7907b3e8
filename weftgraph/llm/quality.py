"""Line-first cleaning: rules per line, then a document rule on what was lost.

Each non-blank line, trimmed, is put to five rules in this order: ``symbols`` (too many marks
that prose does not use), ``navigation`` (separator bars or menu words alone), ``boilerplate`` (a stock
phrase for every STOCK_EVERY characters or more), ``repetition`` (words that repeat the word before) and ``punctuation``
(no sentence end at all). Menu words and phrases are English, German, French and Spanish, sentence ends are of many scripts. A line that fails any rule goes. A document goes when less than
``min_kept`` of its characters, in trimmed non-blank lines, remain. All of it is Catalyst
expressions over one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, tidy

SENTENCE_END = r"""[.!?…。！？।॥؟۔։።]["')\]»”’]*( |$)"""
SYMBOLS = r"[!#$%&*+<=>\\^`{|}~]"
SEPARATORS = r" [|»›>·] "
#: Words of menus in English, German, French and Spanish; of two with the same start the longer comes first.
MENU_WORDS = (
    "home|menu|log ?in|log ?out|sign in|sign up|register|next|previous|prev|back to top|skip to (main )?content|"
    "read more|share this|share|search|contact us|contact|about us|about|sitemap|help|faq|print|close|"
    "startseite|start|menü|anmelden|abmelden|registrieren|weiterlesen|weiter|zurück|nach oben|zum inhalt springen|mehr erfahren|teilen|suche|kontakt|über uns|"
    "impressum|datenschutz|hilfe|drucken|schließen|"
    "accueil|connexion|déconnexion|se connecter|s'inscrire|suivant|précédent|haut de page|aller au contenu|lire la suite|en savoir plus|partager|"
    "rechercher|recherche|contactez-nous|à propos|plan du site|mentions légales|aide|imprimer|fermer|"
    "inicio|menú|iniciar sesión|cerrar sesión|registrarse|siguiente|anterior|volver arriba|ir al contenido|leer más|compartir|buscar|"
    "contáctenos|contacto|acerca de|sobre nosotros|mapa del sitio|aviso legal|ayuda|imprimir|cerrar"
)
#: Possessive groups: no backtracking and no recursion, however long the line.
MENU = rf"^(?:(?:{MENU_WORDS})[ .|»>/:·-]*+)++$"
STOCK = (
    "lorem ipsum|cookie policy|privacy policy|terms of (use|service)|enable javascript|javascript (is )?(disabled|required)|"
    "subscribe to our|all rights reserved|click here|accept (all )?cookies|"
    "alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|allgemeine geschäftsbedingungen|(bitte )?aktivieren sie javascript|newsletter abonnieren|"
    "hier klicken|klicken sie hier|(alle )?cookies akzeptieren|cookie-richtlinie|"
    "tous droits réservés|politique de confidentialité|conditions (générales )?d'utilisation|activer javascript|abonnez-vous à notre|cliquez ici|"
    "accepter (tous )?les cookies|politique (relative aux|de) cookies|"
    "todos los derechos reservados|política de (privacidad|cookies)|términos (de uso|y condiciones)|activar javascript|habilite javascript|suscríbase a nuestr|"
    "haga clic aquí|aceptar (todas )?las cookies"
)
#: One of these is in every stock phrase: looked for first, they spare most lines the pattern.
STOCK_PARTS = (
    "lorem ipsum|cookie|privacy policy|terms of |javascript|subscribe to our|rights reserved|click here|rechte vorbehalten|datenschutzerkl|nutzungsbeding|geschäftsbeding|"
    "newsletter abon|klicken|droits réserv|confidentialité|d'utilisation|abonnez-vous|cliquez ici|derechos reserv|privacidad|términos|suscríbase|haga clic"
).split("|")
RULES = ("kept", "symbols", "navigation", "boilerplate", "repetition", "punctuation")
MAX_SYMBOLS, MAX_REPEATED, MIN_KEPT = 0.08, 0.3, 0.5
#: A line is boilerplate when it has a stock phrase for every so many of its characters, or more.
STOCK_EVERY = 300
STATS = ("n_lines", "n_lines_kept", "chars_total", "chars_kept", *(f"cut_{r}" for r in RULES[1:]))


def _q(pattern: str) -> str:
    """A Spark SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def line_rule(line: str, low: str, max_symbols: float = MAX_SYMBOLS, max_repeated: float = MAX_REPEATED) -> str:
    """Spark SQL for the number in RULES of the first rule that ``line`` fails, 0 for none; ``low`` is it in lower case."""
    words = f"split({line}, ' ')"
    some = " OR ".join(f"contains({low}, {_q(k)})" for k in STOCK_PARTS)
    return f"""CASE
        WHEN regexp_count({line}, {_q(SYMBOLS)}) > {max_symbols}D * length({line}) THEN 1
        WHEN regexp_count({line}, {_q(SEPARATORS)}) >= 2 OR {low} RLIKE {_q(MENU)} THEN 2
        WHEN ({some}) AND {STOCK_EVERY} * regexp_count({low}, {_q(STOCK)}) >= length({line}) THEN 3
        WHEN size({words}) >= 4 AND size(filter(zip_with({words}, slice({words}, 2, size({words})), (a, b) -> a = b), e -> e)) > {max_repeated}D * size({words}) THEN 4
        WHEN NOT {line} RLIKE {_q(SENTENCE_END)} THEN 5
        ELSE 0 END"""


def clean(df: DataFrame, text_col: str = "text", min_kept: float = MIN_KEPT) -> DataFrame:
    """All rows with ``clean_text``, ``accepted`` and the counts in STATS.

    ``clean_text`` has the lines that pass, trimmed and joined by a line feed. A document whose text is
    null, empty or blank has no line, is not accepted and has ``clean_text`` ''. Lines of any length are put to the same rules. Repeated rows are
    judged one by one, alike. Columns that have the name of an output get ``_in`` behind theirs.
    """
    df = tidy(df, ("clean_text", "accepted", "__t", "__l", *STATS), keep=(text_col,))
    names = df.columns
    lines = F.expr(r"filter(transform(split(coalesce(__t, ''), '\n'), x -> btrim(x, ' \t\r')), x -> x <> '')")
    judged = df.withColumn("__t", col(text_col)).withColumn("__l", lines)
    low = F.expr("transform(__l, x -> named_struct('line', x, 'low', lower(x)))")
    rules = F.expr(f"transform(__l, x -> named_struct('line', x.line, 'n', length(x.line), 'rule', {line_rule('x.line', 'x.low')}))")
    # a generator, so that filters on what is counted below do not judge the lines again
    judged = judged.withColumn("__l", low).select(*[col(c) for c in names], F.explode(F.array(rules)).alias("__l"))
    chars = lambda cond: F.expr(f"aggregate(__l, 0L, (s, x) -> s + CASE WHEN {cond} THEN x.n ELSE 0 END)")
    count = lambda cond: F.expr(f"CAST(size(filter(__l, x -> {cond})) AS BIGINT)")
    out = judged.select(
        *[col(c) for c in names],
        F.expr(r"array_join(transform(filter(__l, x -> x.rule = 0), x -> x.line), '\n')").alias("clean_text"),
        F.size("__l").cast("bigint").alias("n_lines"),
        count("x.rule = 0").alias("n_lines_kept"),
        chars("true").alias("chars_total"),
        chars("x.rule = 0").alias("chars_kept"),
        *[count(f"x.rule = {i}").alias(f"cut_{r}") for i, r in enumerate(RULES) if i],
    )
    return out.withColumn("accepted", (F.col("chars_kept") > 0) & (F.col("chars_kept") >= F.lit(min_kept) * F.col("chars_total")))


def oracle(min_kept: float = MIN_KEPT) -> str:
    """DuckDB SQL for ``clean`` on documents: the accepted rows with their cleaned text."""
    d = lambda p: "'" + p.replace("'", "''") + "'"
    return rf"""
WITH l AS (
  SELECT doc_id, lang, source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM documents),
w AS (SELECT *, list_transform(l, lambda x: {{'line': x, 'n': length(x), 'w': string_split(x, ' ')}}) AS ws FROM l),
j AS (SELECT doc_id, lang, source, list_transform(ws, lambda x: {{'line': x.line, 'n': x.n, 'rule': CASE
    WHEN len(regexp_extract_all(x.line, {d(SYMBOLS)})) > {MAX_SYMBOLS} * x.n THEN 1
    WHEN len(regexp_extract_all(x.line, {d(SEPARATORS)})) >= 2 OR regexp_matches(lower(x.line), {d(MENU.replace("*+", "*").replace("++", "+"))}) THEN 2
    WHEN {STOCK_EVERY} * len(regexp_extract_all(lower(x.line), {d(STOCK)})) >= x.n THEN 3
    WHEN len(x.w) >= 4 AND len(list_filter(range(1, len(x.w)), lambda i: x.w[i] = x.w[i + 1])) > {MAX_REPEATED} * len(x.w) THEN 4
    WHEN NOT regexp_matches(x.line, {d(SENTENCE_END)}) THEN 5
    ELSE 0 END}}) AS j FROM w),
s AS (SELECT doc_id, lang, source, coalesce(array_to_string(list_transform(list_filter(j, lambda x: x.rule = 0), lambda x: x.line), chr(10)), '') AS text,
  CAST(len(j) AS BIGINT) AS n_lines, CAST(len(list_filter(j, lambda x: x.rule = 0)) AS BIGINT) AS n_lines_kept,
  CAST(coalesce(list_sum(list_transform(j, lambda x: x.n)), 0) AS BIGINT) AS chars_total,
  CAST(coalesce(list_sum(list_transform(list_filter(j, lambda x: x.rule = 0), lambda x: x.n)), 0) AS BIGINT) AS chars_kept,
  {", ".join(f"CAST(len(list_filter(j, lambda x: x.rule = {i})) AS BIGINT) AS cut_{r}" for i, r in enumerate(RULES) if i)} FROM j)
SELECT doc_id, text, lang, source, CAST(length(text) AS BIGINT) AS n_chars, n_lines, n_lines_kept, chars_total, chars_kept, {", ".join(f"cut_{r}" for r in RULES[1:])}
FROM s WHERE chars_kept > 0 AND chars_kept >= {min_kept} * chars_total"""


def accepted(df: DataFrame) -> DataFrame:
    """The accepted documents with ``text`` and ``n_chars`` replaced by those of the cleaned text, and the counts."""
    out = clean(df)
    names = [c for c in out.columns if c.lower() not in ("clean_text", "accepted")]
    new = {"text": F.col("clean_text").alias("text"), "n_chars": F.length("clean_text").cast("bigint").alias("n_chars")}
    return out.filter("accepted").select(*[new.get(c.lower(), col(c)) for c in names])
