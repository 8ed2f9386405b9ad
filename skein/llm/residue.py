"""Template residue and error-page text: alignment of same-template records.

Every text is cut to sentences. Those that may be residue are turned to a template by masking what varies (the suspected
value, names, numbers), and aligned with all other records of the same template over the whole collection:

* a slot that keeps a delimited variable name, or a request to fill it in, is residue if other records have the same
  template, or if the same variable is left over in other records;
* other slots are induced: what stands between the same words in other records, where it varies. A record whose value there
  is a variable's name in marks of any kind, a default, a blank or nothing is residue; so is such a value that is the whole
  text, or follows a label of its own name, or stands alone in its line where the name is left over elsewhere;
* a page in the form of a server's answer is residue if its form recurs, or if it has a status of failure and is the whole
  text; with such a status, its form is its structure (tags, names of headers or keys) and no value of it. Its slot gives the
  messages of that server, and a sentence elsewhere that is one of these messages as a whole is residue too;
* a notice about scripts is aligned over one free slot (the thing that can't be shown), and is residue if its template
  recurs, if it stands in a noscript element, or if it is the whole text; what noscript elements say is a notice elsewhere;
* filler is told by words that occur in sentences of known filler words and hardly anywhere else, by one short sentence
  repeated over and over, or by a stock sentence that a good part of the records that have it repeat.

A code span that is nothing but a placeholder, quoted text, and code blocks around messages only speak about such things.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Words that only filler has, chosen for this operator.
SEEDS = frozenset(["lorem", "ipsum", "dolor", "amet", "asdf", "qwer", "qwerty", "foo", "bar", "bla", "blah", "xxx"])
#: How templating languages delimit a value to come; N is the variable's name.
DELIMITERS = [r"\{\{\s*N\s*\}\}", r"\$!?\{\s*N\s*\}", r"#\{\s*N\s*\}", r"<<\s*N\s*>>", r"<%=?\s*N\s*%>", r"\{%\s*N\s*%\}", r"@@\s*N\s*@@", r"__N__", r"%\(N\)s", r"%N%", r"\[\[\s*N\s*\]\]"]
#: Words of a request to fill in a value, before or after its name.
ASK_BEFORE = ["your", "insert", "enter", "add", "bitte", "hier", "ihr", "ihre", "remplir", "insérer", "compléter", "votre", "completar", "insertar", "rellenar", "introducir", "su"]
ASK_AFTER = ["goes here", "here", "ergänzen", "einfügen", "eintragen", "ausfüllen", "ici", "à compléter", "à remplir", "aquí", "por completar"]
#: What programs print for a missing value, and authors for one to come. ``None`` and ``N/A`` are answers too often.
DEFAULTS = frozenset(["undefined", "null", "(null)", "nan", "nil", "tbd", "tba", "todo", "fixme"])
#: Tags that need no end.
TAGS = frozenset(["br", "hr", "img", "li", "input", "link", "meta", "p", "td", "th", "tr"])
#: What a notice says is needed.
SCRIPTS = r"(?i)\b(?:javascript|js|scripts?|skripte?n?)\b"

EVIDENCE = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("key", pa.string()), ("sub", pa.string()), ("n", pa.int64()), ("m", pa.int64())])
VALUES = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("value", pa.string()), ("named", pa.bool_())])
LEAST_WORDS, FILLER_SHARE, LEXICON_SHARE, LEXICON_LEAST, REPEATS, SHORT, SLOT_WORDS, HELD_WORDS, STOCK_SHARE = 4, 0.35, 0.5, 3, 3, 60, 4, 200_000, 0.25
#: A slot is induced from so many different values; its records with no value may be that share; so many words may be a value.
LEAST_VALUES, ODD_SHARE, NAMED_SHARE, VALUE_WORDS, FILTER_BITS = 3, 0.5, 0.8, 8, 20


def _patterns() -> dict[str, re.Pattern]:
    name = r"([A-Za-z][\w.]*(?: [\w.]+)?)"
    before, after = "|".join(ASK_BEFORE), "|".join(ASK_AFTER)
    ask = rf"[\[(<](?:{before})\s([^\[\]()<>\n]+?)(?:\s(?:{after}))?[\])>]|[\[(<]([^\[\]()<>\n]+?)\s(?:{after})[\])>]"
    return {
        "slot": re.compile("|".join(d.replace("N", name) for d in DELIMITERS) + "|(?i:" + ask + ")"),
        "plain": re.compile(r"\{\{.*\}\}|\$!?\{\s*[A-Za-z][\w.]{2,}\s*\}|<%.*%>|\{%.*%\}|@@.*@@|%[A-Z]\w{2,}%|[\[(<][^\[\]()<>]* [^\[\]()<>]*[\])>]"),
        "fence": re.compile(r"```.*?(?:```|\Z)", re.S),
        "span": re.compile(r"`[^`\n]*`"),
        "quote": re.compile(r'"[^"\n]*"|«[^»\n]*»|„[^“”\n]*[“”]|“[^”\n]*”'),
        "cut": re.compile(r"\n+|(?<=[.!?…])\s+"),
        "failure": re.compile(r"(?is)<(title|h1)[^>]*>(?:(?!</\1).)*?\b[45]\d\d\b|^HTTP/\d(?:\.\d)? [45]\d\d|^\{\s*\"status\":\s*[45]\d\d|^\w+\s*[45]\d\d\s*:"),
        "structure": re.compile(r"</?[A-Za-z][A-Za-z0-9]*|\"[^\"\n]*\"(?=\s*:)|^[\w-]+(?=:)|^HTTP/|^\w+(?=\s*\d{3}\s*:)", re.M),
        "varying": re.compile(r'(?<=: )"[^"\n]*"|[^\s<>"]*\d[^\s<>"]*'),
        "word": re.compile(r"[^\W\d_]+"),
        "token": re.compile(r"[\[<{][^\[\]<>{}\n]{1,40}[\]>}]|[^\s.,;:!?]+(?:[.:][^\s.,;:!?]+)*|[.,;:!?]+"),
        "odd": re.compile(r"[\[<{]\s*(?P<n1>[A-Za-z][\w.-]{2,}(?: [\w.-]+){0,2})\s*[\]>}]|[$%](?P<n2>[A-Za-z][\w.]{2,})|(?P<blank>_{3,})"),
        "gap": re.compile(r"(?<=\w)\s+(?=[,.](?:\s|$))"),
        "label": re.compile(r"\s*[^\W\d_][^:\n]{0,40}:(?:\s|$)"),
        "scripts": re.compile(SCRIPTS),
        "noscript": re.compile(r"(?is)<noscript>(.*?)</noscript>"),
        "page": re.compile(r"(?i)<html>.*?<h1>(?P<html>.*?)</h1>.*?</html>|(?s:<html[^>]*>(?:(?!</?html).)*?<h1[^>]*>(?P<long>(?:(?!</?html).)*?)</h1>(?:(?!</?html).)*?</html>)|\{\s*\"status\":\s*\d{3},\s*\"error\":\s*\"(?P<json>.*?)\"[^}]*\}|(?m:(?:^|(?<=\s))(?:error|erreur|fehler)\s*\d{3}\s*:\s*(?P<line>.*)$)|HTTP/\d(?:\.\d)? \d{3}[^\n]*\n(?:[\w-]+:[^\n]*\n)*\n?(?P<http>[^\n]*)"),
    }


def _plain(s: str) -> str:
    bare = re.sub(r"^\W*(?:error|erreur|fehler)\s+\d{3}\W+|\([0-9a-f]{4,}\)", " ", s.lower())  # a status before it, a number after it
    return " ".join(re.sub(r"[\W_]+", " ", bare).split())


def _rest(text: str, page: re.Match) -> str:
    """What a text has besides a page: after the first line of an HTTP body, the body's rest belongs to the page."""
    after = "" if page.group(0)[:5].upper() == "HTTP/" and len(text) - page.end() < 2 * SHORT else text[page.end() :]
    return re.sub(r"(?i)<!doctype[^>]*>", "", text[: page.start()]).strip() + after.strip()


def _number(s: str) -> int:
    return int.from_bytes(blake2b(s.encode(), digest_size=8).digest(), "big", signed=True)


def _tokens(P: dict[str, re.Pattern], s: str) -> list[str]:
    return P["token"].findall(s)


def _constant(tokens: list[str]) -> list[str]:
    return [re.sub(r"\d+", "9", t.lower()) for t in tokens]


def _masked(P: dict[str, re.Pattern], text: str) -> str:
    """``text`` without code and quotations; what is left over in a known form is a box."""
    return P["slot"].sub("□", P["quote"].sub("§", P["span"].sub("◊", P["fence"].sub("◊", text))))


def _odd(P: dict[str, re.Pattern], token: str, tags: str) -> tuple[str, str] | None:
    """What kind of missing value a token is, and the name in it; ``tags`` is the text in lower case."""
    if token.lower() in DEFAULTS:
        return "default", ""
    m = P["odd"].fullmatch(token)
    if not m or (token[0] == "<" and ((n := m["n1"].lower()) in TAGS or f"</{n}" in tags)):
        return None
    return ("blank", "") if m["blank"] else ("name", (m["n1"] or m["n2"]).lower())


def _holes(P: dict[str, re.Pattern], doc: int, text: str) -> Iterator[tuple]:
    """Candidates of slots without a value: the words around each, its kind, and if it needs no other record."""
    plain, low = _masked(P, text), text.lower()
    lines = [x for x in plain.split("\n") if x.strip()]

    def row(before: list[str], after: list[str], kind: str, name: str, alone: bool) -> tuple:
        before, after = _constant(before), _constant(after)
        mask = (1 << FILTER_BITS) - 1
        head = crc32(" ".join(before).encode())
        return "hole", doc, " ".join(before) + "\0" + " ".join(after), f"{kind} {name}", (head & mask) << FILTER_BITS | crc32(" ".join(after).encode(), crc32(b"\0", head)) & mask, int(alone)

    for at, line in enumerate(lines):
        pieces = [x.strip() for x in P["cut"].split(line) if x.strip()]
        for s in pieces:
            if "◊" in s:
                continue
            t = _tokens(P, s)
            for i, x in enumerate(t):
                if odd := _odd(P, x, low):
                    kind, name = odd
                    label = set(_constant(t[: i - 1])) if i > 1 and t[i - 1] == ":" else set()
                    whole = plain.strip() == x
                    alone = whole or (kind == "blank" and bool(label) and i == len(t) - 1) or (kind == "name" and bool(label & set(re.split(r"[\W_]+", name))))
                    if alone or len(t) > 1:
                        yield row(t[:i], t[i + 1 :], kind, name, alone)
                    if kind == "name" and len(t) == 1 == len(pieces):
                        yield "lone", doc, None, name, 0, 0
            for m in P["gap"].finditer(s):
                k = len(_tokens(P, s[: m.start()]))
                yield row(t[:k], t[k:], "empty", "", False)
        s = line.strip()
        if len(pieces) == 1 and "◊" not in s and len(t := _tokens(P, s)) > 1 and (at + 1 == len(lines) or P["label"].match(lines[at + 1])) and t[-1] == ":":
            yield row(t, [], "empty", "", False)


def _values(heads: bytes, wholes: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to what stands in the slots that the two bit sets may have, and if it is like a name or number."""
    P = _patterns()
    mask = (1 << FILTER_BITS) - 1

    def has(bits: bytes, c: int) -> int:
        c &= mask
        return bits[c >> 3] >> (c & 7) & 1

    def about(doc: int, text: str) -> Iterator[tuple]:
        low = text.lower()
        for s in P["cut"].split(_masked(P, text)):
            t = _tokens(P, s)
            c, head = _constant(t), 0
            for i in range(len(t)):
                if i:
                    head = crc32((" " * (i > 1) + c[i - 1]).encode(), head)
                if not has(heads, head):
                    continue
                mark = crc32(b"\0", head)
                for k in range(i + 1, min(len(t), i + VALUE_WORDS) + 1):
                    if has(wholes, crc32(" ".join(c[k:]).encode(), mark)) and "□" not in (value := " ".join(t[i:k])) and value[0] not in ".,;:!?":
                        if not (k == i + 1 and _odd(P, t[i], low)):
                            yield doc, " ".join(c[:i]) + "\0" + " ".join(c[k:]), value, value[0].isupper() or bool(re.search(r"\d", value))

    for b in batches:
        rows = [x for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if text and not text.isspace() for x in about(doc, text)]
        columns = list(zip(*rows)) if rows else [()] * len(VALUES)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, VALUES)], schema=VALUES)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to rows of evidence; the words' counts of a task are put together."""
    P = _patterns()
    words: dict[str, list[int]] = {}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(EVIDENCE)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, EVIDENCE)], schema=EVIDENCE)

    def lexicon() -> pa.RecordBatch:
        made = batch([("word", None, w, None, n, m) for w, (n, m) in words.items()])
        words.clear()
        return made

    def mask(s: str) -> str:
        return re.sub(r"\d+", "9", P["span"].sub("◊", P["slot"].sub("□", s)))

    def about(doc: int, text: str) -> Iterator[tuple]:
        # a code span, or a line of a code block, that is nothing but a placeholder is a quotation
        spoken = P["fence"].sub(lambda f: "\n".join("◊" if P["slot"].fullmatch(x.strip()) else x for x in f.group(0).split("\n")), text)
        spoken = P["span"].sub(lambda c: "◊" if P["slot"].fullmatch(c.group(0)[1:-1].strip()) else c.group(0), spoken)
        slots = [(s, m) for s in P["cut"].split(P["quote"].sub("§", spoken)) for m in P["slot"].finditer(s)] if P["slot"].search(spoken) else []
        for s, m in slots:
            alone = P["plain"].fullmatch(m.group(0)) and (s.strip() == m.group(0) or re.search(r":\s*$", s[: m.start()]))
            yield "slot", doc, mask(s), next(g for g in m.groups() if g).lower().rpartition(".")[2], len(slots), int(bool(alone))
        yield from _holes(P, doc, text)
        prose = P["span"].sub("◊", P["fence"].sub("◊", text))
        for m in P["page"].finditer(prose):
            message = next((g for g in m.groups() if g), "")
            failure = P["failure"].match(m.group(0)) or (m.group(0)[0] == "<" and P["failure"].search(m.group(0)))
            if failure:
                page = " ".join(P["structure"].findall(m.group(0))).lower()
            else:
                # no status of failure: the words count too, but not a quoted value, nor a word with a digit in it
                page = P["varying"].sub("9", m.group(0).replace(message, "□") if message else m.group(0)).lower()
            whole = bool(failure) and not _rest(prose, m)
            for s in P["cut"].split(message) or [""]:
                yield "page", doc, page, _plain(s), _number(_plain(s)), int(whole)
        sentences = [s.strip() for s in P["cut"].split(prose) if s.strip()]
        inside = {s.strip() for x in P["noscript"].findall(prose) for s in P["cut"].split(x)}
        told = [s for s in sentences if P["scripts"].search(P["quote"].sub("§", s)) and "◊" not in s]
        for s in told:
            bare = re.sub(r"(?i)</?noscript>", "", s)
            alone = bare.strip() in inside or "<noscript>" in prose.lower() or (len(sentences) < 4 and all(x in told or len(x) < SHORT for x in sentences))
            w = _plain(P["scripts"].sub("jj", bare)).split()
            for i in range(len(w)):
                for k in range(SLOT_WORDS + 1):
                    if (k == 0 and i == 0) or (0 < k <= len(w) - i and len(w) - k >= LEAST_WORDS - 1 and "jj" not in w[i : i + k]):
                        yield "notice", doc, " ".join([*w[:i], *["_"] * (k > 0), *w[i + k :]]), None, int(alone), 0
        for x in inside:
            yield "notice", doc, "", None, 1, 0
            yield "told", doc, None, None, _number(_plain(x)), 0
        run, longest = 1, {}
        for i, s in enumerate(sentences):
            if "◊" in s:
                run = 1
                continue
            run = run + 1 if i and s == sentences[i - 1] else 1
            w = [x.lower() for x in P["word"].findall(s)]
            if run == REPEATS and (len(s) < SHORT or 2 * REPEATS * len(s) > len(text)) and len(w) > 1 and not re.search(r"\d", s):
                yield "repeated", doc, s, None, 0, 0
            known = set(w) & SEEDS
            for x in set(w):
                seen = words.setdefault(x, [0, 0])
                seen[0] += 1
                seen[1] += len(known) > 1
            poor = len(w) >= 2 * LEAST_WORDS and len(set(w)) <= 0.8 * len(w)
            if (known or poor) and (len(w) >= LEAST_WORDS or (len(w) == LEAST_WORDS - 1 and known == set(w))):
                yield "filler", doc, str(i), " ".join(w), 0, 0
            plain = _plain(s)
            longest[plain] = max(run if len(w) > 1 else 1, longest.get(plain, 1))
        for plain, times in longest.items():
            yield "sentence", doc, None, None, _number(plain), times

    for b in batches:
        rows: list[tuple] = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text and not text.isspace():
                rows += about(doc, text)
            if len(rows) > 20_000:
                yield batch(rows)
                rows = []
        yield batch(rows)
        if len(words) > HELD_WORDS:
            yield lexicon()
    yield lexicon()


def _bits(holes: DataFrame, shift: int) -> bytes:
    """A set of the ``FILTER_BITS`` bits from ``shift`` on: a fixed size, whatever the number of candidates."""
    c = F.shiftright("n", shift).bitwiseAND((1 << FILTER_BITS) - 1)
    parts = holes.select(c.alias("c")).groupBy(F.shiftright("c", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("c").bitwiseAND(32767)).alias("bits")).collect()
    made = bytearray(1 << FILTER_BITS - 3)
    for part, bits in parts:
        made[part << 12 : (part + 1) << 12] = bits
    return bytes(made)


def _missing(texts: DataFrame, holes: DataFrame) -> DataFrame:
    """``doc_id, name`` of the candidates that lack a value in a slot, or need no other record."""
    heads, wholes = _bits(holes, FILTER_BITS), _bits(holes, 0)
    values = texts.mapInArrow(lambda batches: _values(heads, wholes, batches), "doc_id bigint, key string, value string, named boolean")
    filled = values.groupBy("key").agg(F.count_distinct("value").alias("n_values"), F.count_distinct("doc_id").alias("n_docs"), F.avg(F.col("named").cast("int")).alias("share"))
    kept = holes.select("doc_id", "key", F.split("sub", " ", 2)[0].alias("kind"), F.split("sub", " ", 2)[1].alias("name"), F.col("m").alias("alone"))
    left = kept.groupBy("key").agg(F.count_distinct("doc_id").alias("n_left"))
    slot = filled.join(left, "key").where(f"n_values >= {LEAST_VALUES} and n_docs >= {LEAST_VALUES} and n_left <= {ODD_SHARE} * (n_docs + n_left)").select("key", "share")
    # a missing word is told from words only where the values are names or numbers: "is null" and "is open" are both said
    induced = kept.join(slot, "key").where(f"kind in ('name', 'blank') or share >= {NAMED_SHARE}").select("doc_id", "name")
    return written(induced.unionByName(kept.where("alone = 1").select("doc_id", "name")).distinct())


def residue(documents: DataFrame) -> DataFrame:
    """``doc_id, reason`` of texts with residue: ``placeholder``, ``error_page``, ``script_notice``, ``filler``; each once.

    ``documents`` has ``doc_id, text``; other columns are ignored. Null, empty and blank texts have none. Rows of one
    doc_id are judged together; a null doc_id gets no result. What recurs is told over all rows: at least two documents.
    """
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = written(texts.mapInArrow(_evidence, "kind string, doc_id bigint, key string, sub string, n bigint, m bigint"))
    kind = lambda k: found.where(F.col("kind") == k)

    def recurring(df: DataFrame, c: str) -> DataFrame:
        return df.groupBy(c).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(c)

    slots = kind("slot")
    placeholders = slots.where("m = 1").select("doc_id")
    for c in ("key", "sub"):
        placeholders = placeholders.unionByName(slots.join(recurring(slots, c), c, "left_semi").select("doc_id"))
    named = placeholders.join(slots, "doc_id").select("sub")
    missing = _missing(texts, kind("hole"))
    names = missing.where("name <> ''").select(F.col("name").alias("sub")).unionByName(named).distinct()
    placeholders = placeholders.unionByName(missing.select("doc_id")).unionByName(kind("lone").join(names, "sub", "left_semi").select("doc_id"))
    pages = kind("page").join(recurring(kind("page"), "key"), "key", "left_semi")
    pages = pages.unionByName(kind("page").where("m = 1").select(pages.columns))
    messages = pages.where("sub rlike '[a-z].* .*[a-z]' or (sub <> '' and m = 0 and not sub rlike '^[0-9 ]*$')").select(F.col("n").alias("number")).distinct()
    sentences = kind("sentence")
    errors = pages.select("doc_id").unionByName(sentences.join(messages, F.col("n") == F.col("number"), "left_semi").select("doc_id"))
    notices = kind("notice")
    scripts = notices.where("n = 1").select("doc_id").unionByName(notices.join(recurring(notices, "key"), "key", "left_semi").select("doc_id"))
    told = kind("told").select(F.col("n").alias("number")).distinct()
    scripts = scripts.unionByName(sentences.join(told, F.col("n") == F.col("number"), "left_semi").select("doc_id"))
    # m: how often in a row; stock filler is doubled in two documents at least, and in a good part of those that have it
    stock = sentences.groupBy("n").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("m") > 1).alias("doubled")).where(f"doubled > 1 and doubled >= {STOCK_SHARE} * docs").select(F.col("n").alias("number"))
    lexicon = kind("word").groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where((F.col("m") >= F.greatest(F.lit(LEXICON_LEAST), LEXICON_SHARE * F.col("n"))) | F.col("key").isin(sorted(SEEDS))).select(F.col("key").alias("word"))
    said = kind("filler").select("doc_id", "key", F.explode(F.split("sub", " ")).alias("word"))
    known = said.join(lexicon.withColumn("known", F.lit(1)), "word", "left").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("k"))
    filler = known.where(f"k >= {FILLER_SHARE} * n").select("doc_id").unionByName(kind("repeated").select("doc_id")).unionByName(sentences.join(stock, F.col("n") == F.col("number"), "left_semi").select("doc_id"))
    parts = [d.select("doc_id", F.lit(r).alias("reason")) for d, r in ((placeholders, "placeholder"), (errors, "error_page"), (scripts, "script_notice"), (filler, "filler"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()
