"""Template residue and error-page text: regularised linear classifiers trained on weak labels.

Weak labels come from response-status, notice, filler and placeholder phrases, on a bounded sample (SAMPLE documents, by
hash of the id). Two logistic regressions learn from them, and neither sees what the phrases said:

* pages: a document is weakly positive if most of its body is residue, negative if little is, and unlabelled in between.
  Features are hashed character n-grams of the text (their shares), of its first line and of its name, its length, the
  share of markup characters and how much of the text repeats.
* spans: bracketed or otherwise delimited spans outside code, positive if they are unfilled placeholders. Features are
  hashed n-grams of the span and of its shape. A document has the score of its best span.

A document is residue if either score passes its threshold. Hosts (the source) are split three ways: three in five are
fitted on, every fourth chooses the thresholds, every fifth only reports. Scoring reads every text whole and runs no
phrase of the weak labels.

Defined results: null and empty texts are not residue; a null source is a host of its own; very long texts are scored
whole; copies are scored each; documents without an id are left out; on an empty table, or where the sample holds one
class only, the weak rule alone decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.fingerprints import gram_hashes, joined
from terrane.runtime import spread

#: Longer lines are judged sentence by sentence.
LONG = 400
GRAM, BITS, SAMPLE, STEPS, PENALTY = 5, 17, 8_000, 80, 1e-4
SPAN_BITS = 15
_CHARS = 2_000_000

# Placeholder syntaxes, and phrases of status pages, script notices and filler.
PLACEHOLDERS = (
    r"\{\{\s*[\w.\- ]+\s*\}\}",
    r"\$\{\s*[\w.\- ]+\s*\}",
    r"\{\$\s*[\w.\-]+\s*\}",
    r"#\{\s*[\w.\- ]+\s*\}",
    r"\{%\s*[\w.\- ]+\s*%\}",
    r"<%=?\s*[\w.\- ]+\s*%>",
    r"<<[\w.\-]+>>",
    r"@@\s*[\w.\-]+\s*@@",
    r"\[\[\s*[\w.\-]+\s*\]\]",
    r"(?<![\w%])%[A-Za-z_][\w.]{2,}%(?!\w)",
    r"(?<!\w)__[A-Z][A-Z0-9_.]*[A-Z0-9]__(?!\w)",
    r"\[[A-Z][A-Z0-9_.]* HERE\]",
    r"\[(?:TBD|TODO|INSERT|PLACEHOLDER)\b[^\]\n]{0,40}\]",
    r"<(?:insert|enter|your)\s[^<>\n]{1,40}>",
    r"【请(?:填写|输入|插入)[^】\n]{0,20}】",
    r"[（(](?:此处|在此)(?:填入|填写|插入)[^）)\n]{0,20}[）)]",
)
STATUS = (
    r"\b(?:error|fehler|erreur|http(?:/\d(?:\.\d)?)?|status|code)\W{0,4}[45]\d\d\b|错误码?\W{0,3}[45]\d\d|[（(][45]\d\d[）)]$",
    r"\b[45]\d\d\W{1,3}(?:bad|unauthorized|forbidden|not found|internal|gateway|service|too many|request|method)",
    r"(?:internal server error|bad gateway|service unavailable|gateway time-?out|too many requests|403 forbidden|404 not found)",
    r"access (?:is )?denied|permission to view|not authorized to|zugriff verweigert|accès refusé|没有权限查看|无权(?:访问|查看)",
    r"page (?:isn['’]t|is not|not) (?:available|found)|page you (?:were|are) looking for|does not exist\. it may|seite wurde nicht gefunden|page est introuvable|(?:页面|网页)(?:不存在|已被删除|无法)",
    r"something went wrong|upstream connect error|error establishing a|connection (?:refused|timed out|reset)|scheduled maintenance|be back shortly|wartungsarbeiten|en maintenance|维护中",
    r"系统内部错误|请联系管理员|请求超时|服务器(?:繁忙|错误|内部)|登录已(?:失效|过期)|请重新登录|session (?:has )?expired|sitzung (?:ist )?abgelaufen",
    r"^traceback \(most recent|^\s+file \"[^\"]+\", line \d+|^\s*(?:raise )?\w*(?:error|exception)\b\s*[:(]",
)
SCRIPTS = (
    r"(?:enable|turn on|activate|allow|requires?|with|without|needs?|run|support).{0,40}(?:java ?script|\bscripts?\b)",
    r"(?:java ?script|\bscripts?\b).{0,40}(?:disabled|blocked|switched off|turned off|required|enabled|deaktiviert|désactivé)",
    r"<noscript|(?:aktivieren|einschalten).{0,20}javascript|(?:activer|activez).{0,20}javascript|javascript.{0,20}(?:aktivieren|activer)",
    r"(?:开启|启用|需要|允许|支持|未).{0,12}(?:javascript|脚本)|(?:javascript|脚本).{0,12}(?:禁用|关闭|支持|启用)|checking your browser",
)
FILLER = (
    r"^[xX.·\-_*#\s]{3,}$",
    r"占位文字|待补充|示例文本|填充文字|测试文字",
    r"(?:text|paragraph|content|copy|title) goes here|lorem ipsum|replace this (?:text|paragraph)|^sample (?:heading|text|paragraph)\W*$|blindtext|faux[- ]texte|^click to edit|^add your \w+\W*$|^loading\W*$",
)
#: A line that can match one of the above holds one of these, a number of the 4xx or 5xx kind, or is filler of one character.
STEMS = (
    "error|exception|bad gateway|forbidden|unavailable|too many|time-out|timeout|"
    "denied|refusé|verweigert|not authorized|permission to|没有权限|无权|page is|page not|page you|not found|does not exist|seite wurde|page est|页面|网页|"
    "something went|upstream|connection|scheduled maint|be back|wartungs|en maintenance|维护中|系统内部|联系管理员|请求超时|服务器|登录|expired|abgelaufen|traceback|file \"|raise |"
    "script|脚本|checking your|占位|待补充|示例文本|填充文字|测试文字|goes here|lorem ipsum|replace this|sample |blindtext|faux|click to|add your|loading"
)
#: Words of a text that talks about such phrases instead of showing them.
TALK = r"\b(?:usually|means? that|because|such as|so we|we (?:ask|added|use|saw|count|keep|drop)\w*|our|counted|replaced by|wir|unsere?|nous|notre|nos)\b|时，|检测由|命中率|替换为|负责|我们|因为|表示|通常|为何|说明"

FILLER_WORDS = r"(?:lor[eu]m|ips|dolor|amet|consec|tetur|adipi|elit|sedum?$|sed$|tempor|incid|labor|magn|aliq|veni|enim|quis|exerc|minim|sit(?:que)?$|x{3,}$|asdf|qwer|blah$|foo$|bar$|baz$|test$|text$|abc$|xyz$)"
FURNITURE = r"^\W*(?:#{1,6} .*|\d{1,2}\.\d{1,2}\.\d{2,4}|(?:home|docs|contact|imprint|impressum|start|back|menu|kontakt|accueil|首页)\b[^.!?。]{0,80})$|^[\w \-]{1,40}$|^[^|]{1,30}(?:\|[^|]{1,30}){1,5}$|^[\w\-]{2,30}/\d[\d.]*$"

_PLACE = re.compile("|".join(PLACEHOLDERS))
_HINT = re.compile(r"[{$#%<@\[_【（(]")
_LINE = re.compile("|".join((*STATUS, *SCRIPTS, *FILLER)), re.I)
_NUMBER = re.compile(r"[45]\d\d")
_NUMBERED = re.compile("|".join(STATUS[:2]), re.I)
_ONE = re.compile(FILLER[0])
# of a long line: markup and the ends of its sentences
_MARKUP = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>|<(?!noscript)[/!a-z][^<>]*>", re.I)
_ENDS = re.compile(r"\n|(?<=[.!?])\s+|(?<=[。！？；])")
_FILL = re.compile(FILLER_WORDS, re.I)
_FURN = re.compile(FURNITURE, re.I)
_TALK = re.compile(TALK, re.I)
_CODE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_INLINE = re.compile(r"(`+)(?!`)[^\n]*?[^`]\1(?!`)|`[^`\n]`")
_WORDS = re.compile(r"[^\W\d_]+")
#: Delimited spans of a line, whatever they hold.
_SPAN = re.compile(r"[$#]?\{{1,2}[^{}\n]{1,60}\}{1,2}|<{1,2}[^<>\n]{1,60}>{1,2}|\[{1,2}[^\[\]\n]{1,60}\]{1,2}|%[^%\s]{1,40}%|@@[^@\n]{1,40}@@|__[^\s]{1,40}?__|【[^】\n]{1,40}】|（[^）\n]{1,40}）|\([^()\n]{1,60}\)")
_UPPER, _LOWER = re.compile(r"[A-Z]+"), re.compile(r"[^\W\d_A-Z]+")
_MARKS = np.zeros(128, bool)
_MARKS[[ord(c) for c in "<>{}[]|#*=/\\;$%@_"]] = True
DENSE = ("placeholder", "placeholders", "residue", "mainly", "lines", "length", "short", "titled", "markup")


@lru_cache(1)
def _stems() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k in STEMS.split("|"):
        out.add_word(k, k)
    out.make_automaton()
    return out


def outside_code(text: str) -> str:
    if "`" not in text and "~~~" not in text:
        return text
    return _INLINE.sub(" ", _CODE.sub("\n", text))


def placeholders(text: str) -> int:
    """Unfilled placeholders in running text, not in inline or fenced code."""
    if not _PLACE.search(text):
        return 0
    return len(_PLACE.findall(outside_code(text)))


def _may_match(line: str) -> re.Pattern | None:
    """The pattern that decides, None only for lines that _LINE can't match."""
    low = line.lower()
    if not low.isascii():  # letters that match s and i when case is ignored, but have another lower case
        low = low.replace("\u017f", "s").replace("\u0131", "i").replace("i\u0307", "i")
    if next(_stems().iter(low), None) or _ONE.search(line):
        return _LINE
    return _NUMBERED if _NUMBER.search(line) else None  # without a stem only phrases with a number are left


@lru_cache(1 << 14)
def _fills(word: str) -> bool:
    return bool(_FILL.match(word))


def _filler(text: str) -> bool:
    words = _WORDS.findall(text)
    return len(words) >= 4 and sum(map(_fills, words)) >= 0.7 * len(words)


def _is_residue(line: str) -> bool:
    pattern = _may_match(line)
    return bool(pattern and pattern.search(line) and not _TALK.search(line)) or _filler(line)


def _around(text: str) -> int:
    """Characters within half of LONG of a phrase, for a sentence longer than LONG."""
    pattern, bad, last = _may_match(text), 0, 0
    for m in pattern.finditer(text) if pattern else ():
        a, b = max(0, m.start() - LONG // 2), min(len(text), m.end() + LONG // 2)
        if not _TALK.search(text[a:b]):
            bad, last = bad + max(0, b - max(a, last)), max(b, last)
    return bad


def _judged(line: str) -> tuple[int, int]:
    """(characters, characters that are residue) of a line; the markup of a long line does not count."""
    if len(line) <= LONG:
        return len(line), len(line) * _is_residue(line)
    if _filler(line):
        return len(line), len(line)
    total = bad = 0
    for part in _ENDS.split(_MARKUP.sub("\n", line) if "<" in line else line):
        part = part.strip()
        total += len(part)
        bad += len(part) * _is_residue(part) if len(part) <= LONG else len(part) if _filler(part) else _around(part)
    return total, bad


def residue_share(text: str) -> tuple[float, int]:
    """Share of the body's characters in residue lines or sentences, and the number of lines that are mostly residue. Titles and page furniture are no body."""
    total = bad = n = 0
    seen: dict[str, tuple[int, int]] = {}
    lines = [x for x in (raw.strip() for raw in text.splitlines()) if x]
    for line in lines:
        if line not in seen:
            seen[line] = _judged(line)
        size, residual = seen[line]
        if not residual and len(lines) > 1 and len(line) <= 120 and _FURN.match(line):
            continue
        total += size
        bad += residual
        n += residual > 0 and 2 * residual >= size
    return (bad / total if total else 0.0), n


def dense(text: str, title: str | None) -> list[float]:
    p = placeholders(text)
    share, n = residue_share(text)
    head = text.lstrip()[:200].split("\n", 1)[0]
    return [float(p > 0), min(p, 5) / 5, share, float(share >= 0.5), min(n, 10) / 10, np.log1p(len(text)) / 10, float(len(text) < 300), float(bool(_LINE.search(head)) or bool(title and _LINE.search(title))), float(text.lstrip().startswith("<"))]


def weak(x: list[float]) -> int | None:
    """1 residue, 0 content, None undecided."""
    if x[0] or x[2] >= 0.5:
        return 1
    return 0 if x[2] < 0.3 else None


def _parts(ids, texts, titles):
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _CHARS:
            yield ids[start:i], texts[start:i], titles[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield ids[start:], texts[start:], titles[start:]


def hashed(texts: list[str], n: int = GRAM, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every character n-gram; digits count as one."""
    c, at = joined([t.lower() for t in texts])
    c = np.where((c >= 48) & (c <= 57), 48, c)
    h = gram_hashes(c, n)
    size = np.maximum(np.diff(at) - n + 1, 0)
    doc = np.repeat(np.arange(len(texts)), size)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[:-1], size)
    return doc, (h[pos] >> np.uint64(64 - bits)).astype(np.int64)


def _shares(doc: np.ndarray, bucket: np.ndarray, n: int, bits: int, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value): each bucket's share of the text's n-grams, scaled."""
    cell, times = np.unique(doc << bits | bucket, return_counts=True)
    d = cell >> bits
    return d, cell & ((1 << bits) - 1), (scale * times / np.maximum(np.bincount(d, times, minlength=n), 1)[d]).astype(np.float32)


def page_features(texts: list[str], titles: list[str | None]):
    """(row, bucket, value, dense): n-grams of the text, of its first line and of its name, and the plain features."""
    n = len(texts)
    heads = [t.lstrip().split("\n", 1)[0] for t in texts]
    parts, repeats = [], np.zeros(n)
    for k, (many, scale) in enumerate(((texts, 30.0), (heads, 6.0), ([t or "" for t in titles], 3.0))):
        row, bucket, value = _shares(*hashed(many, GRAM if k < 2 else 3), n, BITS, scale)
        if not k:
            repeats = 1 - np.bincount(row, minlength=n) / np.maximum([len(t) for t in texts], 1)
        parts.append((row, bucket ^ (k * 0x9E37), value))
    c, at = joined(texts)
    marks = np.append(0, np.cumsum(_MARKS[np.minimum(c, 127)] & (c < 128)))
    size = np.maximum(np.diff(at), 1)
    dense_part = np.c_[np.log1p(size) / 10, size < 300, (marks[at[1:]] - marks[at[:-1]]) / size, repeats, [t.lstrip().startswith("<") for t in texts], [len(h) / 200 if len(h) < 200 else 1.0 for h in heads], np.ones(n)]
    return *(np.concatenate(x) for x in zip(*parts)), dense_part


def spans(texts: list[str]) -> tuple[list[int], list[str]]:
    """(text, span) of every delimited span outside code."""
    doc, out = [], []
    for i, t in enumerate(texts):
        if _HINT.search(t):
            found = set(_SPAN.findall(outside_code(t)))
            doc += [i] * len(found)
            out += found
    return doc, out


def span_features(found: list[str]):
    """(row, bucket, value, dense): n-grams of one to four characters of the span and of its shape."""
    n, cells = len(found), []
    shapes = [_LOWER.sub("a", _UPPER.sub("A", t)) for t in found]
    for k, many in enumerate((found, shapes)):
        for g in (1, 2, 3, 4):
            c, at = joined([f"\x02{t}\x03" for t in many])
            c = np.where((c >= 48) & (c <= 57), 48, c)
            h, size = gram_hashes(c, g), np.maximum(np.diff(at) - g + 1, 0)
            row = np.repeat(np.arange(n), size)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[:-1], size)
            cells.append(row << SPAN_BITS | ((h[pos] >> np.uint64(64 - SPAN_BITS)).astype(np.int64) ^ (0x1F35 * (4 * k + g))) & ((1 << SPAN_BITS) - 1))
    cell = np.unique(np.concatenate(cells)) if cells else np.zeros(0, np.int64)
    row = cell >> SPAN_BITS
    value = 4 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
    return row, cell & ((1 << SPAN_BITS) - 1), value[row].astype(np.float32), np.ones((n, 1))


class Linear:
    """Logistic regression with hashed and dense features, classes weighted alike."""

    def __init__(self, bits: int):
        self.bits, self.threshold = bits, 0.5
        self.hashed, self.dense = np.zeros(1 << bits), np.zeros(0)

    def _linear(self, row, bucket, value, full) -> np.ndarray:
        return np.bincount(row, self.hashed[bucket] * value, minlength=len(full)) + full @ self.dense

    def fit(self, row, bucket, value, full, y: np.ndarray) -> Linear:
        self.dense = np.zeros(full.shape[1])
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        sg, sd = np.full(1 << self.bits, 1e-12), np.full(full.shape[1], 1e-12)
        for _ in range(STEPS):
            err = weight * (1 / (1 + np.exp(-np.clip(self._linear(row, bucket, value, full), -50, 50))) - y)
            g = np.bincount(bucket, err[row] * value, minlength=1 << self.bits) + PENALTY * self.hashed
            d = full.T @ err + PENALTY * 0.1 * self.dense
            sg, sd = sg + g * g, sd + d * d
            self.hashed -= 0.15 * g / np.sqrt(sg)
            self.dense -= 0.6 * d / np.sqrt(sd)
        self.hashed = self.hashed.astype(np.float32)
        return self

    def scores(self, row, bucket, value, full) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._linear(row, bucket, value, full), -50, 50)))

    def settle(self, p: np.ndarray, y: np.ndarray) -> None:
        """The threshold of the best F1; the middle of the best ones."""
        if y.any() and not y.all():
            f = [(round(f1(p > c / 40, y), 6), c / 40) for c in range(2, 39)]
            best = [c for x, c in f if x == max(f)[0]]
            self.threshold = best[len(best) // 2]


def f1(said: np.ndarray, y: np.ndarray) -> float:
    return float(2 * (said & (y == 1)).sum() / max(1, said.sum() + y.sum()))


class Model:
    """Both classifiers; a missing one leaves its part to the weak rule."""

    def __init__(self, pages: Linear | None, holes: Linear | None):
        self.pages, self.holes = pages, holes

    def scores(self, texts: list[str], titles: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(page score, placeholder score) of every text, scaled so that a half is the threshold."""
        n = len(texts)
        page = np.array([float(residue_share(t)[0] >= 0.5) for t in texts]) if self.pages is None else self._scaled(self.pages, page_features(texts, titles))
        best = np.zeros(n)
        if self.holes is None:
            return page, np.array([float(placeholders(t) > 0) for t in texts])
        doc, found = spans(texts)
        if found:
            np.maximum.at(best, doc, self._scaled(self.holes, span_features(found)))
        return page, best

    @staticmethod
    def _scaled(model: Linear, features) -> np.ndarray:
        p, t = model.scores(*features), model.threshold
        return np.where(p > t, 0.5 + 0.5 * (p - t) / (1 - t), 0.5 * p / t)


def _joined_features(parts):
    """Feature parts of successive texts as one."""
    rows, at, cols = [], 0, []
    for row, bucket, value, full in parts:
        rows.append((row + at, bucket, value))
        cols.append(full)
        at += len(full)
    return *(np.concatenate(x) for x in zip(*rows)), np.concatenate(cols)


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (text, title, host) with the share of residue in the body and the number of placeholders."""
    for b in batches:
        texts = b.column(0).to_pylist()
        more = pa.array([residue_share(t)[0] for t in texts], pa.float64()), pa.array([placeholders(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns, *more], ["text", "title", "host", "share", "holes"])


def train(rows: list[tuple[str, str | None, str | None]], labels: list[tuple[float, int]] | None = None) -> tuple[Model | None, dict]:
    """Fit on (text, title, host) rows with weak labels (share of residue, placeholders), taken from the texts where they are
    not given; returns the model and its figures on the hosts that only report: f1 of whole documents, f1_pages and f1_spans."""
    texts, titles = [r[0] for r in rows], [r[1] for r in rows]
    hosts = [(r[2] or "").strip().lower() for r in rows]
    names = {h: i % 5 for i, h in enumerate(sorted(set(hosts)))}
    role = np.array([names[h] for h in hosts], np.int64)
    labels = [(residue_share(t)[0], placeholders(t)) for t in texts] if labels is None else labels
    share = np.array([x for x, _ in labels], float)
    page = np.where(share >= 0.5, 1, np.where(share < 0.3, 0, -1))
    hole = np.array([x > 0 for _, x in labels], bool)
    doc, found = spans(texts)
    span_role, span_y = role[np.array(doc, np.int64)], np.array([bool(_PLACE.search(t)) for t in found], np.int64)

    def learn(bits, features, role, y, blocks) -> tuple[Linear | None, float | None]:
        part = lambda keep: _joined_features([features(b) for b in blocks(np.flatnonzero(keep))])
        fit = (role < 3) & (y >= 0)
        if len(set(y[fit].tolist())) < 2:
            return None, None
        model = Linear(bits).fit(*part(fit), y[fit])
        choose, report = (role == 3) & (y >= 0), (role == 4) & (y >= 0)
        if choose.any():
            model.settle(model.scores(*part(choose)), y[choose])
        return model, f1(model.scores(*part(report)) > model.threshold, y[report]) if y[report].any() else None

    blocks = lambda size: lambda at: [at[s : s + size] for s in range(0, len(at), size)]  # noqa: E731 bounds the n-grams held at once
    pages, page_f1 = learn(BITS, lambda at: page_features([texts[i] for i in at], [titles[i] for i in at]), role, page, blocks(200))
    holes, span_f1 = learn(SPAN_BITS, lambda at: span_features([found[i] for i in at]), span_role, span_y, blocks(20_000))
    figures = {"fitted": int((role < 3).sum()), "tested": int((role == 4).sum())}
    if pages is None and holes is None:
        return None, figures
    model = Model(pages, holes)
    at = np.flatnonzero((role == 4) & (page >= 0))
    if len(at):
        parts = [model.scores([texts[i] for i in b], [titles[i] for i in b]) for b in blocks(200)(at)]
        said = np.concatenate([np.maximum(*p) for p in parts]) > 0.5
        figures |= {"f1": round(f1(said, ((page == 1) | hole)[at].astype(int)), 4), "f1_pages": page_f1, "f1_spans": span_f1}
    return model, figures


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value or Model(None, None)
        for b in batches:
            for ids, texts, titles in _parts(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                page, hole = model.scores(texts, titles)
                p = np.maximum(page, hole)
                kind = np.where(hole > 0.5, "placeholder", "page").tolist()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(p, pa.float64()), pa.array(p > 0.5), pa.array(kind)], ["doc_id", "score", "residue", "kind"])

    return run


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, score, residue, kind) of every document with a text."""
    docs = documents.select("doc_id", "text", F.col("document_name").alias("title"), F.col("source").alias("host")).where("doc_id is not null and text is not null and length(trim(text)) > 0")
    n = docs.count()
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(min(1_000_000, 1_000_000 * SAMPLE // max(n, 1))))
    # a hash of the unique id picks SAMPLE rows but for a few
    labelled = spread(picked.select("text", "title", "host"), "text").mapInArrow(_label, "text string, title string, host string, share double, holes bigint")
    rows = labelled.collect()[: SAMPLE + SAMPLE // 10]
    model, _ = train([tuple(r)[:3] for r in rows], [tuple(r)[3:] for r in rows])
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return spread(docs.select("doc_id", "text", "title"), "doc_id").mapInArrow(_score(shared), "doc_id bigint, score double, residue boolean, kind string")
