"""Operator 7: line-first cleaning.

Every line is judged: punctuation (too many symbols or exclamation marks, no letter or digit, or a line
of some length in which no sentence ends), navigation (a short line without any stop, a bar- or arrow-separated menu, or
menu words only), boilerplate (a stock phrase), in English, German, French and Spanish. A line alone decides, but for the
end of its sentence: in a paragraph of lines that are wrapped at up to WRAPPED characters a later line may hold it. Failing lines go; a
document that loses over MAX_LOSS percent of its words' characters is rejected.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from rasterlake.llm import work
from rasterlake.llm.wordhash import Words, window_hashes

MIN_WORDS, MAX_REPEAT, MAX_LOSS = 50, 50, 40
SYMBOLS = "[#*$%&|<>]"
#: Stock phrases by language, lower case.
PHRASES = {
    "en": "all rights reserved|privacy policy|cookie policy|we use cookies|terms of use|terms of service|terms and conditions|enable javascript|subscribe to our|click here|sign up for|share on facebook|follow us on|powered by|read more|back to top",
    "de": "alle rechte vorbehalten|datenschutzerklärung|allgemeine geschäftsbedingungen|verwendet cookies|javascript aktivieren|newsletter abonnieren|hier klicken|jetzt anmelden|weiterlesen|nach oben",
    "fr": "tous droits réservés|politique de confidentialité|mentions légales|conditions générales|utilise des cookies|activer javascript|abonnez-vous|cliquez ici|lire la suite|haut de page",
    "es": "todos los derechos reservados|política de privacidad|aviso legal|términos y condiciones|utiliza cookies|active javascript|habilitar javascript|suscríbete|haga clic aquí|leer más|volver arriba",
}
BOILERPLATE = "|".join([*PHRASES.values(), "lorem ipsum"])
#: Words of menus by language, lower case.
MENU_WORDS = {
    "en": "home|about|contact|login|logout|register|search|menu|sitemap|help|faq|next|previous|blog|news|archive|categories|tags|cart|account|imprint",
    "de": "startseite|über|uns|kontakt|anmelden|abmelden|suche|hilfe|weiter|zurück|impressum|datenschutz|warenkorb|konto|archiv|nachrichten",
    "fr": "accueil|à|propos|connexion|déconnexion|rechercher|aide|suivant|précédent|panier|compte|actualités|plan|du|site",
    "es": "inicio|acerca|de|contacto|acceder|salir|buscar|ayuda|siguiente|anterior|carrito|cuenta|noticias|mapa|del|sitio",
}
#: The rules as regular expressions that mean the same in Python, Java and RE2.
NO_WORD = "[\\x20\\x09-\\x0D]*"
NAVIGATION = "[^.!?:;]{1,30}"  # the whole line; with SHORT words at most
MENU = f"[ ]*(?:(?:{'|'.join(MENU_WORDS.values())})[ ,/·•-]*)+"  # the whole line
SEPARATED = "(?: [|»›•·] .*){2}"  # a menu of three entries or more
SHORT, LONG = 3, 10
#: What a line of LONG words or more needs: a stop, and closing marks after it, at its end or before a blank.
ENDED = "[.!?:;…][\"'”’»)\\]]*([\\x20\\x09-\\x0D]|$)|[।॥。！？．؟۔።။]"
WRAPPED = 100  # characters of the longest line of a paragraph that counts as wrapped

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " kept boolean, n_lines long, punctuation_lines long, navigation_lines long, boilerplate_lines long, kept_chars long"
)

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_WORD, _SYMBOLS, _STOCK = re.compile("[^\\x20\\x09-\\x0D]+"), re.compile(SYMBOLS), re.compile(BOILERPLATE)
_NAVIGATION, _MENU, _SEPARATED, _ENDED = re.compile(NAVIGATION), re.compile(MENU), re.compile(SEPARATED), re.compile(ENDED)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÀÍÓ", "abcdefghijklmnopqrstuvwxyzäöüéèàíó")


def line_fault(line: str) -> str | None:
    """The first rule that a line with a word fails when it stands alone."""
    fault = _fault(line)
    return "punctuation" if fault == "unended" else fault


def _fault(line: str) -> str | None:
    """line_fault(), but "unended" where only no sentence ends in the line."""
    words = len(_WORD.findall(line))
    if 2 * len(_SYMBOLS.findall(line)) > words or 2 * line.count("!") > words or not any(map(str.isalnum, line)):
        return "punctuation"
    low = line.translate(_UPPER)
    if words <= SHORT and _NAVIGATION.fullmatch(line) or _SEPARATED.search(line) or _MENU.fullmatch(low):
        return "navigation"
    if _STOCK.search(low):
        return "boilerplate"
    return "unended" if words >= LONG and not _ENDED.search(line) else None


def line_faults(text: str | None) -> list[tuple[str, str | None]]:
    """The lines of a text that have a word, in order, each with the rule that it fails. Lines without a word part paragraphs. In one without a longer
    line than WRAPPED, the sentence that a line doesn't end may end in a later line; otherwise that fails as punctuation."""
    out: list[tuple[str, str | None]] = []
    begin = 0

    def close() -> None:
        ended, wrapped = False, max(map(len, (x for x, _ in out[begin:])), default=0) <= WRAPPED
        for i in range(len(out) - 1, begin - 1, -1):
            line, fault = out[i]
            if fault == "unended":
                out[i] = line, None if ended and wrapped else "punctuation"
            ended = ended or bool(_ENDED.search(line))

    for line in (text or "").split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            out.append((line, _fault(line)))
        else:
            close()
            begin = len(out)
    close()
    return out


def _chars(line: str) -> int:
    return len(re.sub("[\\x20\\x09-\\x0D]", "", line))


def _repeats(hashes: np.ndarray) -> int:
    """Words inside 3-word windows that occur at least twice; hashes: of a document's windows in order."""
    n = len(hashes)
    if n < 2:
        return 0
    _, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
    again = count[which] > 1
    covered = np.zeros(n + 2, bool)
    for j in range(3):
        covered[j : j + n] |= again
    return int(covered.sum())


def clean_lines(docs: DataFrame, max_loss: int = MAX_LOSS, with_text: bool = True) -> DataFrame:
    """Base counts and verdict of every document, its whole text, and with_text its cleaned text (clean_text).

    Null or empty texts have no words (zeros, base_failed, not kept, clean_text empty); repeated rows are
    judged alike, each on its own; columns other than doc_id and text are not read, whatever their names."""

    def make():
        def one(c: dict) -> list:
            texts = c["text"]
            words = Words(texts, lower=False)
            windows = window_hashes(words.hashes(), 3)
            solid = np.ones(len(words.buf) + 1, np.int64)
            solid[:-1] = (words.buf & 0xC0) != 0x80
            solid[:-1][np.isin(words.buf, [9, 10, 11, 12, 13, 32])] = 0
            chars = np.concatenate([[0], np.cumsum(solid)])
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[words.buf])])
            n_chars = chars[words.doc_end] - chars[words.doc_start]
            n_symbols = symbols[words.doc_end] - symbols[words.doc_start]
            n_words = words.last - words.first
            rows = []
            for k, text in enumerate(texts):
                n, a = int(n_words[k]), int(words.first[k])
                repeats = _repeats(windows[a : a + n - 2]) if n >= 4 else 0
                faults = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
                good, lines, kept = [], [], 0
                for line, fault in line_faults(text):
                    lines.append(line)
                    if fault:
                        faults[fault] += 1
                    else:
                        good.append(line)
                        kept += _chars(line)
                failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT * n
                total = int(n_chars[k])
                keep = not failed and 100 * (total - kept) <= max_loss * total
                rows.append((c["doc_id"][k], n, total, int(n_symbols[k]), len(lines) - len(set(lines)), repeats, failed, keep, len(lines), *faults.values(), kept, *(["\n".join(good)] if with_text else [])))
            return [list(x) for x in zip(*rows, strict=True)]

        return one

    return work.map_batches(work.pick(docs, "doc_id", "text"), SCHEMA + ", clean_text string" * with_text, make)


def op7_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return clean_lines(work.read(spark, sf_dir, "documents"), with_text=False)


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
l1 AS (SELECT *, sum(CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS para FROM l0),
l AS (SELECT *, max(length(line)) OVER p <= {WRAPPED} AND max(CASE WHEN regexp_matches(line, '{ENDED.replace("'", "''")}') THEN i ELSE 0 END) OVER p > i AS goes_on FROM l1 WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW p AS (PARTITION BY doc_id, para)),
m AS (SELECT doc_id, line, goes_on, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
  length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, length(regexp_replace(line, '[^!]', '', 'g')) AS shouts,
  translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÀÍÓ', 'abcdefghijklmnopqrstuvwxyzäöüéèàíó') AS low
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT *, CASE WHEN 2 * symbols > n OR 2 * shouts > n OR NOT regexp_matches(line, '[\p{{L}}\p{{N}}]') THEN 'p'
  WHEN n <= {SHORT} AND regexp_full_match(line, '{NAVIGATION}') OR regexp_matches(line, '{SEPARATED}') OR regexp_full_match(low, '{MENU}') THEN 'n'
  WHEN regexp_matches(low, '{BOILERPLATE}') THEN 'b'
  WHEN n >= {LONG} AND NOT goes_on AND NOT regexp_matches(line, '{ENDED.replace("'", "''")}') THEN 'p' END AS fault FROM m),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (fault = 'p') AS p, count(*) FILTER (fault = 'n') AS n,
  count(*) FILTER (fault = 'b') AS b, coalesce(sum(chars) FILTER (fault IS NULL), 0) AS kept_chars FROM f GROUP BY doc_id),
x AS (SELECT doc_id, unnest(range(len(w) - 2)) AS i, w FROM d WHERE len(w) >= 3),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i + 1], w[i + 2], w[i + 3]) AS c FROM x),
z AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS j FROM y WHERE c > 1) GROUP BY doc_id),
r AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(p, 0) AS p, coalesce(n, 0) AS n,
  coalesce(b, 0) AS b, coalesce(kept_chars, 0) AS kept_chars FROM d LEFT JOIN g USING (doc_id) LEFT JOIN z USING (doc_id)),
s AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND 100 * (word_chars - kept_chars) <= {MAX_LOSS} * word_chars AS kept,
  CAST(n_lines AS BIGINT) AS n_lines, CAST(p AS BIGINT) AS punctuation_lines, CAST(n AS BIGINT) AS navigation_lines, CAST(b AS BIGINT) AS boilerplate_lines, CAST(kept_chars AS BIGINT) AS kept_chars
FROM s
"""
