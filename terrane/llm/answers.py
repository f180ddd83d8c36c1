"""Broken prompt and response pairs.

Noisy labelling functions vote for or against each defect, or abstain; an expectation-maximisation label model learns
their accuracies from all pairs (only counts of vote patterns reach the driver, at most 3 ** functions rows per defect)
and gives posteriors. Labels whose posterior passes its cutoff are kept, so a pair may carry several; the cutoffs are
chosen on the labelled pairs of VALIDATION.

The functions of a defect look at different things. Beside phrases, punctuation and scripts they use three small models,
fitted on every row: character profiles of languages (all texts with a language and the sentences of SEEDS), a character
n-gram classifier of refusals (REFUSALS against all truth statements) and the statistics of how truth statements end;
besides these the statements that are known to be true, where there are any. The models are counts of hashed n-grams:
executors count, the sums reach the driver (at most 2 ** 15 a language, 2 ** 15 + 2 ** 13 for the statements).

Defined results: a null answer, no statements or null statements are `empty`; a null question can be neither copied
nor in another language; pairs delivered twice are one pair and pairs without an id are left out, also of the models;
very long answers are read whole; an empty table gives no rows; without truths and documents the models know the fixed
sentences only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.fingerprints import gram_hashes
from terrane.llm.fingerprints import joined as in_a_row
from terrane.runtime import materialize

#: Characters whose n-grams are hashed at once, languages a task counts before it hands them on.
PIECE, LANGUAGES = 1 << 14, 64
#: What the n-grams counted for a model weigh at most beside its smoothing and its seeds: all of them are counted, and
#: their shares then say the same in a table of any size; else the smoothing fades and each new n-gram says more and more.
WEIGHT = 1 << 18
#: Letters below which a profile says nothing; nats by which one language must lead.
LETTERS, LEAD = 14, 4.0

# The defects and, as plain text, the words the labelling functions look for.
DEFECTS = ("empty", "copied_question", "refusal", "other_language", "truncated")
STAND_INS = (
    "n/a na n.a. n.a null none nil nan undefined unknown tbd empty (empty) blank no value|no answer|not available|not applicable|"
    "无|暂无|空|空白|没有|无内容|不适用|无答案|待定|未提供|keine|k.a.|k. a.|ka|keine angabe|entfällt|leer|nichts|fehlt|"
    "néant|aucun|aucune|vide|rien|s.o.|s. o.|sans objet|non disponible"
)
CONNECTIVES = {
    "en": "the a an and or but because which that with of in to for from by on at as if when while than then such until unless into is are was were so order in-order such-as per its their this these only",
    "de": "der die das ein eine einen und oder aber weil dass mit von in zu für aus bei auf als wenn bis sowie dem den des ist sind im am zum zur dann damit",
    "fr": "le la les un une des du de et ou mais parce que qui avec dans pour par sur au aux si car en à est sont ensuite comme son sa ses",
}
CONNECTIVES_ZH = "以及 因为 从而使 从而 并且 但是 而且 或者 如果 例如 包括 其中 并 与 和 的 在 为 将 把 被 使 会 由 及 或 若 向 先 再 约 对 至 自 且 于 可以 可 仅 只 已 因 所以 等待"
STOPWORDS = {
    "en": "the of and is are when how does do what why may with for in to from it its before after be has have says each only while that this if at as was were which can keep set ask by over",
    "de": "der die das und ist sind wann wie was warum darf mit für im bei nach sich nicht ein eine zu von vor auf den dem seit so unter wird ohne hier alles wichtig gilt werden kann",
    "fr": "le la les et est sont quand comment pourquoi combien que peut avec pour dans il elle du des un une au sans sur par ne pas tout ici fait selon chez entre depuis avant après cette",
}
# sentences of everyday prose that start the language profiles
SEEDS = {
    "en": "It is not clear whether the report will be ready before the end of the week. You should check the settings again and then try to send the file once more. There are several reasons why this could have happened to them.",
    "de": "Es ist nicht klar, ob der Bericht noch vor dem Ende der Woche fertig sein wird. Sie sollten die Einstellungen prüfen und dann versuchen, die Datei noch einmal zu senden. Es gibt mehrere Gründe, warum das geschehen sein könnte.",
    "fr": "On ne sait pas encore si le rapport sera prêt avant la fin de la semaine. Vous devriez vérifier les réglages puis essayer d'envoyer le fichier une nouvelle fois. Il y a plusieurs raisons pour lesquelles cela a pu arriver.",
    "es": "No está claro si el informe estará listo antes de que termine la semana. Debería comprobar los ajustes y después intentar enviar el archivo una vez más. Hay varias razones por las que esto pudo haber ocurrido. Lo siento, pero no puedo responder a esa pregunta. El sistema guarda los datos durante la noche y los borra cuando ya no se necesitan.",
    "it": "Non è chiaro se la relazione sarà pronta prima della fine della settimana. Dovresti controllare le impostazioni e poi provare a inviare di nuovo il file. Ci sono diversi motivi per cui questo può essere accaduto. Mi dispiace, non posso rispondere a questa domanda. Il sistema conserva i dati durante la notte e li cancella quando non servono più.",
    "pt": "Não está claro se o relatório ficará pronto antes do fim da semana. Você deve verificar as configurações e depois tentar enviar o arquivo mais uma vez. Há várias razões pelas quais isso pode ter acontecido. Desculpe, não posso responder a essa pergunta. O sistema guarda os dados durante a noite e apaga-os quando já não são necessários.",
    "nl": "Het is niet duidelijk of het rapport voor het einde van de week klaar zal zijn. U moet de instellingen controleren en daarna proberen het bestand nog een keer te versturen. Er zijn verschillende redenen waarom dit gebeurd kan zijn. Het systeem bewaart de gegevens in de nacht en wist ze wanneer ze niet meer nodig zijn.",
}
# sentences that decline to answer
REFUSALS = (
    "I'm sorry, but I can't help with that.|I cannot answer this question.|I am not able to assist with that request.|I won't discuss this topic.|I must decline to answer.|Unfortunately I can't provide that information.|"
    "As an assistant, I am unable to comply with your request.|That is something I am not allowed to share.|I would rather not answer that.|No comment.|This is confidential and will not be shared.|I can't show that.|"
    "抱歉，我无法回答这个问题。|对不起，我不能提供该信息。|很遗憾，我无法协助您。|这个问题我不便作答。|我没有权限讨论该内容。|作为助手，我不能满足您的请求。|恕我不能透露。|我拒绝回答。|"
    "Es tut mir leid, dabei kann ich nicht helfen.|Leider kann ich diese Frage nicht beantworten.|Dazu darf ich nichts sagen.|Das möchte ich nicht beantworten.|Als Assistent ist es mir nicht möglich, darauf einzugehen.|"
    "Désolé, je ne peux pas répondre à cette question.|Je ne suis pas en mesure de vous aider.|Malheureusement, je ne peux pas fournir cette information.|Je refuse de répondre.|Il m'est impossible d'en parler.|"
    "Lo siento, no puedo responder a esa pregunta.|No puedo ayudarle con eso.|No me está permitido hablar de eso.|Mi dispiace, non posso rispondere.|Non sono in grado di aiutarti.|Desculpe, não posso ajudar com isso.|Não tenho permissão para responder.|"
    "申し訳ありませんが、お答えできません。|その質問にはお答えできません。|Het spijt me, daar kan ik niet mee helpen."
)
# sentences that only report a refusal, or deny something else
REPORTS = (
    "The page shows 'Sorry, I cannot answer' while the service is down.|The dialog says that the file can't be opened.|Users cannot open the table during the night.|The writer is unable to lock the row.|The job refuses rows without a key.|"
    "离线时，页面会提示“抱歉，我无法回答”。|没有权限的用户不能打开表格。|系统无法读取该文件时会重试。|Die Seite zeigt „Leider kann ich nicht antworten“, solange der Dienst steht.|Ohne Schlüssel kann der Dienst die Zeile nicht lesen.|"
    "La page affiche « Désolé, je ne peux pas répondre » pendant la panne.|Le service ne peut pas lire la ligne sans clé.|The alert reads: I am unable to reach the index."
)
YES_NO = "yes no true false never always none both neither ja nein nie immer oui non jamais toujours sí si não sim 是 是的 否 不是 对 不对 可以 不可以 能 不能 会 不会 有 没有 需要 不需要 支持 不支持 はい いいえ"
TRANSLATION = r"\b(in|into|auf|ins|en)\s+(chinese|english|german|french|chinesisch|englisch|deutsch|französisch|chinois|anglais|allemand|français)\w*\b|用?(中文|英文|英语|德文|德语|法文|法语|汉语)|translat|übersetz|tradui|翻译"
# a refusal speaks for itself, in the first person or without one, about the asked help
REFUSAL = (
    r"\bi (?:can ?not|can['’]t|won['’]t|will not|am unable|am not able|must decline|don['’]t have permission|do not have permission|refuse)"
    r"|\bi['’]m (?:unable|not able|not allowed|not permitted)"
    r"|\b(?:unable|not able|not allowed) to (?:answer|assist|help|provide|discuss)"
    r"|(?:无法|不能|不便|没有权限|恕我不能|拒绝)(?:回答|满足|提供|协助|作答|讨论|处理|透露)|不便作答"
    r"|\b(?:kann|darf|möchte|werde) ich\b.*\b(?:nicht|nichts)\b|\bich (?:kann|darf|möchte|werde)\b.*\b(?:nicht|nichts|kein\w*)\b|ist es mir nicht möglich|mir nicht (?:erlaubt|gestattet|möglich)"
    r"|\bje (?:ne (?:peux|suis|puis|dispose)|refuse|n['’]ai pas)\b|m['’]est impossible"
    r"|^\W*no comment\W*$|\bnot at liberty\b|\b(?:confidential|classified)\b|\bwill not be (?:shared|disclosed|discussed|answered)\b|\brather not (?:say|answer)\b"
    r"|\b(?:no|non|não) (?:puedo|podemos|posso|estoy autorizad\w|sono in grado|tengo permiso|tenho permissão)|お?答えできません|できかねます|お手伝いできません"
)
APOLOGY = r"^\W*(?:i['’]?a?m sorry|sorry|apolog\w+|unfortunately|regret\w*|as an? (?:ai |language )?(?:assistant|model)|抱歉|对不起|不好意思|很遗憾|遗憾|作为(?:一个)?(?:助手|人工智能|语言模型)|恕|tut mir leid|leider|entschuldigung|als assistent|désolée?|malheureusement|navrée?|lo siento|lamentablemente|mi dispiace|desculpe|lamento|申し訳|en tant qu['’]assistant)"
CLOSING = r"anything else|another (?:question|topic)|换一个问题|其他问题|anderen thema|andere frage|autre question|autre sujet"
REPORTED = r"[\"'“”„‘’«»「『](?:[^\"“”„«»」』]{0,80})(?:sorry|cannot|can['’]t|unable|抱歉|无法|不能|对不起|leider|nicht möglich|désolé|impossible)|\b(?:shows?|displays?|returns?|says|reads?|zeigt|meldet|affiche|renvoie)\b[^.!?]{0,40}[:\"“„«]|(?:提示|显示|返回|报错)[^。！？]{0,20}[：:“「]"
LABELS = r"^\W*(?:q(?:uestion)?|prompt|frage|question|问题|问|提问)\s*\d*\s*[:：]\s*"

CLOSERS = "\"'”’»)]）】」』*_`"
_STANDIN = {w for part in STAND_INS.split("|") for w in ([part] if " " in part and not part.startswith("n/a") else part.split())} | {"no value"}
_CONN = {w for s in CONNECTIVES.values() for w in s.split()}
_CONN_ZH = tuple(sorted(CONNECTIVES_ZH.split(), key=len, reverse=True))
_STOP = {k: frozenset(v.split()) for k, v in STOPWORDS.items()}
_YES_NO = frozenset(YES_NO.split())
_RE = {k: re.compile(v, re.I) for k, v in {"translation": TRANSLATION, "refusal": REFUSAL, "apology": APOLOGY, "closing": CLOSING, "reported": REPORTED, "labels": LABELS}.items()}
_CJK = re.compile(r"[㐀-鿿豈-﫿]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_NAME = re.compile(r"[A-Z][a-z]{3,}|\b[A-Z]{2,}-\d+\b|`[^`]*`")
_NO_WORD = re.compile(r"[\W_]+")
_NUMBER = re.compile(r"^\W*\d[\d.,:/ ]*\s*[^\W\d_]{0,12}(?: [^\W\d_]{1,14})?$")
_MARKER = re.compile(r"^\s*(?:[（(]?\d{1,3}[)）.、]|[（(]?[A-Za-z][)）.]|[-*•·]|#+|\||>)\s*$")
_FENCE = re.compile(r"^\s*(?:```|~~~)", re.M)
_PARTICLES = re.compile(r"[的在先把将被使若请因从每即它就您我]")
#: Characters that also end nouns: they count as connectives only in text that is no bare term.
_DOUBTFUL = frozenset("会约对为自向先于并已只仅至中及")


def squash(s: str | None) -> str:
    """Letters and digits only, case folded."""
    return _NO_WORD.sub("", (s or "").casefold())


# scripts that tell a language by themselves
_SCRIPTS = {"ja": re.compile(r"[\u3041-\u30ff]"), "ko": re.compile(r"[\uac00-\ud7af]"), "ru": re.compile(r"[\u0400-\u04ff]"), "ar": re.compile(r"[\u0600-\u06ff]"), "zh": _CJK}

_RARE = re.compile(r"[\u0400-\u04ff\u0600-\u06ff\u3041-\u30ff\uac00-\ud7af]")


def by_script(t: str) -> str | None:
    if t.isascii():
        return None
    words = len(_WORD.findall(_CJK.sub(" ", t))) if _CJK.search(t) else 0
    for k, r in _SCRIPTS.items() if _RARE.search(t) else (("zh", _CJK),):
        n = len(r.findall(t))
        if n >= 2 and (k != "zh" or n >= 2 * words) and (k != "ja" or 5 * n >= len(_CJK.findall(t))):
            return k
    return None


def language(s: str | None) -> str | None:
    """A language by script, or en, de, fr by at least two function words; None without evidence (names, numbers, bare terms)."""
    s = s or ""
    if not s.isascii() and (k := by_script(_NAME.sub(" ", s))):
        return k
    words = [w for w in _WORD.findall(s.lower())]
    hits = {k: len([w for w in words if w in v]) for k, v in _STOP.items()}
    best = max(hits, key=hits.get)
    if hits[best] >= max(2, 0.15 * len(words)) and hits[best] > max(v for k, v in hits.items() if k != best):
        return best
    return None


def _padded(t: str) -> str:
    return f" {t.casefold()} "


def _buckets(texts: list[str], n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every character n-gram of padded texts; digits count as one."""
    c, at = in_a_row(texts)
    c = np.where((c >= 48) & (c <= 57), 48, c)
    h, size = gram_hashes(c, n), np.maximum(np.diff(at) - n + 1, 0)
    doc = np.repeat(np.arange(len(texts)), size)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[:-1], size)
    return doc, (h[pos] >> np.uint64(64 - bits)).astype(np.int64)


def _counted(texts: Iterable[str], n: int, bits: int) -> np.ndarray:
    """How often each bucket occurs in all texts; a text beyond PIECE is cut so that each n-gram lies in one piece."""
    total, some, size = np.zeros(1 << bits, np.int64), [], 0
    for t in map(_padded, texts):
        for i in range(0, len(t) - n + 1, PIECE):
            some.append(t[i : i + PIECE + n - 1])
            size += len(some[-1])
            if size >= PIECE:
                total += np.bincount(_buckets(some, n, bits)[1], minlength=1 << bits)
                some, size = [], 0
    return total + np.bincount(_buckets(some, n, bits)[1], minlength=1 << bits)


class Evidence:
    """Language profiles, refusal classifier and ending statistics; small, broadcast whole.

    `seen` has the counts of `language_counts` by language and those of `statement_counts` by "+others", "+ends", "+inner".
    """

    BITS, TAIL_BITS = 15, 12

    def __init__(self, seen: dict[str, np.ndarray] | None = None):
        seen = dict(seen or {})
        others, ends, inner = (seen.pop(k, 0) for k in ("+others", "+ends", "+inner"))
        own = {k: 3 * _counted([v], 3, self.BITS) for k, v in SEEDS.items()}
        for k, n in seen.items():
            own[k] = own.get(k, 0) + self._weighed(n)
        self.languages = sorted(own)
        self.profiles = np.stack([self._log(own[k], 0.3) for k in self.languages])
        spoken = 3 * _counted(REFUSALS.split("|"), 4, self.BITS)
        others = self._weighed(others) + 3 * _counted(REPORTS.split("|"), 4, self.BITS) + _counted(SEEDS.values(), 4, self.BITS)
        self.refusal = self._log(spoken, 0.05) - self._log(others, 0.05)
        self.ending = np.log((ends + 0.5) / (inner + 0.5)) + np.zeros(1 << self.TAIL_BITS)

    @staticmethod
    def _weighed(count: np.ndarray) -> np.ndarray:
        return count * min(1.0, WEIGHT / max(np.sum(count), 1))

    @staticmethod
    def _log(count: np.ndarray, smooth: float) -> np.ndarray:
        return np.log((count + smooth) / (count + smooth).sum())

    @staticmethod
    def _tails(t: str) -> np.ndarray:
        c = np.frombuffer(t.rstrip().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        return (c[1:] * 31 + c[:-1]) & 4095 if len(c) > 1 else np.zeros(0, np.int64)

    def leads(self, texts: list[str]) -> list[dict[str, float]]:
        """Per text and language the nats by which it falls behind the best; empty where there are too few letters."""
        doc, bucket = _buckets(list(map(_padded, texts)), 3, self.BITS)
        total = np.stack([np.bincount(doc, row[bucket], minlength=len(texts)) for row in self.profiles], axis=1)
        behind = total.max(1, keepdims=True) - total
        return [dict(zip(self.languages, r)) if sum(map(str.isalpha, t)) >= LETTERS else {} for t, r in zip(texts, behind.tolist())]

    def declining(self, texts: list[str]) -> list[float]:
        """Mean log odds of the text's n-grams for a refusal."""
        doc, bucket = _buckets(list(map(_padded, texts)), 4, self.BITS)
        n = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        return (np.bincount(doc, self.refusal[bucket], minlength=len(texts)) / n).tolist()

    def ends(self, t: str) -> float:
        """Log odds that a statement ends as this one does."""
        k = self._tails(t)
        return float(self.ending[k[-1]]) if len(k) else 0.0


def _stands_in(texts: list[str]) -> bool:
    values = [t.strip().strip(".").casefold() for t in texts if squash(t)]
    return bool(values) and all(v in _STANDIN or v + "." in _STANDIN for v in values)


def _empty(x):
    says, stand = bool(x.whole), _stands_in(x.texts)
    return (1 if not x.texts else -1 if says and not stand else 0, 1 if not says else 0 if stand else -1, 1 if stand else -1 if says else 0)


def _grams(t: str, n: int = 4) -> set[str]:
    return {t[i : i + n] for i in range(max(1, len(t) - n + 1))}


def _copied(x):
    want = squash(x.q)
    if not want or not x.whole:
        return (-1, -1, -1, -1)
    own = [squash(_RE["labels"].sub("", t)) for t in x.said]
    rest = "".join(own).replace(want, "")
    if want not in x.whole and len(x.whole) > 4 * len(want):  # holds too much else
        return (-1, -1, -1, -1 if x.joined.strip() in x.truths else 0)
    mine, asked = _grams("".join(own)), _grams(want)
    shared = len(mine & asked)
    covered = shared >= 0.95 * len(mine) and shared >= 0.6 * len(asked)
    return (1 if all(o == want for o in own) else -1, 1 if not rest else -1, 1 if covered else 0 if shared >= 0.8 * len(mine) else -1, -1 if x.joined.strip() in x.truths else 0)


def _refusal(x):
    if not x.said:
        return (-1, -1, -1, -1, -1)
    first = x.said[0]
    polite = bool(_RE["apology"].search(first))
    reported = bool(_RE["reported"].search(first)) and not polite
    declines = bool(_RE["refusal"].search(first)) and not reported
    # only an answer that begins like a refusal has its other statements looked at
    others = declines and any((len(k) > 24 or t.strip() in x.truths) and not any(_RE[r].search(t) for r in ("refusal", "closing", "apology")) for t, k in zip(x.said[1:], x.squashed[1:]))
    like = x.declining
    known = any(t.strip() in x.truths for t in x.said)
    return (
        1 if declines and not others else -1,
        1 if polite and not others and (declines or like > 0) else 0 if declines else -1,
        1 if like > 0.5 and not reported and len(x.said) <= 3 else -1 if like < -0.2 or reported else 0,
        -1 if others or len(x.said) > 4 else 1 if declines and len(x.whole) < 120 else 0,
        -1 if known else 0 if not x.truths else 1 if declines else 0,
    )


def _other_language(x):
    lq = x.asked
    if not x.said or lq is None or _stands_in(x.texts) or _RE["translation"].search(x.q or ""):
        return (-1, -1, -1, -1)
    bare = x.bare
    whole, script = language(x.joined), by_script(bare)
    # statement by statement only where the whole does not settle it
    known = {k for t in x.said if (k := language(t))} if len(x.said) > 1 and whole != lq else {whole} - {None}
    words = 1 if known and lq not in known else -1 if known else 0
    latin = len([w for w in _WORD.findall(_CJK.sub(" ", bare)) if len(w) > 1])
    scripted = lq in _SCRIPTS
    has = bool(_SCRIPTS[lq].search(bare)) if scripted else latin > 0
    wrong = script not in (None, lq) if script else scripted and not has and latin >= 2
    behind = x.behind.get(lq)
    profile = 0 if script or scripted or behind is None else 1 if behind > LEAD else -1 if behind < LEAD / 4 else 0
    if script or (scripted and latin >= 2):
        profile = 1 if wrong else -1
    truth = x.spoken
    return (
        words,
        1 if wrong else -1 if scripted and has else 0,
        profile,
        0 if truth is None or whole is None else 1 if whole != truth == lq else -1 if whole == truth else 0,
    )


def _finished_short(s: str) -> bool:
    """A number, name, list of terms or code span, complete without a full stop."""
    if s.rstrip(".!。！").casefold() in _YES_NO:
        return True
    if re.fullmatch(r"`[^`]+`|\$[^$]+\$", s) or _NUMBER.match(s) or re.fullmatch(r"[\w.+-]+(?:/[\w.+-]+)*", s, re.A):
        return True
    cjk = len(_CJK.findall(s))
    if cjk:
        parts = re.split(r"[和与及、，,/\s]+", s)
        return len(s) <= 40 and not _PARTICLES.search(_NAME.sub("", s)) and all(0 < len(p) <= 8 for p in parts)
    words = _WORD.findall(s)
    inner = [w.lower() for w in words if w.lower() not in ("and", "or", "und", "oder", "et", "ou")]
    return bool(words) and len(words) <= 9 and not any(w in _CONN for w in inner if len(w) > 1) and words[-1].lower() not in ("and", "or", "und", "oder", "et", "ou")


def _truncated(x):
    said, texts, gts = [t for t in x.texts if t.strip()], x.texts, x.gts
    if not said or not x.whole or _stands_in(texts) or (x.q and squash(_RE["labels"].sub("", said[-1])) == squash(x.q)):
        return (-1, -1, -1, -1, 0)
    s = said[-1].strip()
    if not squash(s) and not _MARKER.match(s) and s[-1] not in "`:：,，（(":
        return (-1, -1, -1, -1, 0)
    core = s.rstrip(CLOSERS).rstrip()
    fence = joined_fences(texts)
    ellipsis = bool(re.search(r"(?:\.{3,}|…+|。{3,})$", core))
    end = bool(re.search(r"[.!?。！？]$", core or s)) and not ellipsis and not _MARKER.match(s) and not fence
    if s == "..." or s == "…":
        end = ellipsis = False
    closed = s.endswith("`") and s.count("`") % 2 == 0 and not fence
    balance = sum(s.count(a) for a in "(（[【《「") - sum(s.count(a) for a in ")）]】》」")
    opened = fence or bool(re.search(r"[,;:，；：、(（\[【\-–—/]$", s)) or balance > 0 or bool(_MARKER.match(s))
    last = _WORD.findall(core)
    conn = not end and not closed and not short_word(s) and ((bool(last) and last[-1].lower() in _CONN and core.endswith(last[-1]) and len(last) > 1) or (bool(_CJK.search(core[-1:])) and core.endswith(_CONN_ZH) and (core[-1] not in _DOUBTFUL or not _finished_short(core))))
    cut = any(g and len(g) > len(s) and g.startswith(core or s) for g in gts) if core else False
    # the start of a known statement is no term
    short = not cut and _finished_short(s)
    whole = any(g == s for g in gts)
    shape = -1 if end or closed or (short and not opened and not ellipsis) else 1
    return (
        1 if (opened or ellipsis) and not whole else -1 if end or closed else 0,
        1 if conn else -1 if end else 0,
        shape,
        1 if cut and not end and not whole else -1 if whole or end else 0,
        1 if not end and not closed and not short and x.ends < -1 else -1 if end or x.ends > 1 else 0,
    )


def short_word(s: str) -> bool:
    return s.rstrip(".!。！").casefold() in _YES_NO


def joined_fences(texts: list[str]) -> bool:
    """An odd number of code fences: a block is still open."""
    return sum(len(_FENCE.findall(t)) for t in texts if "```" in t or "~~~" in t) % 2 == 1


FUNCTIONS = {"empty": (_empty, 3), "copied_question": (_copied, 4), "refusal": (_refusal, 5), "other_language": (_other_language, 4), "truncated": (_truncated, 5)}


class Pair:
    """A pair as the functions see it."""

    __slots__ = ("q", "texts", "said", "squashed", "joined", "whole", "gts", "truths", "bare", "behind", "declining", "ends", "asked", "spoken")

    def __init__(self, question, answer, truth):
        self.q = question
        self.texts = [] if answer is None else [t for t in answer if t is not None]
        marked = [(t, k) for t in self.texts if (k := squash(t))]
        self.said, self.squashed = [t for t, _ in marked], [k for _, k in marked]
        self.joined, self.whole = " ".join(self.texts), "".join(self.squashed)
        self.gts = [g for g in (truth if truth is not None else []) if g]
        self.truths = {g.strip() for g in self.gts}
        self.bare = _NAME.sub(" ", self.joined)
        self.behind, self.declining, self.ends, self.asked, self.spoken = {}, 0.0, 0.0, None, None


def all_votes(rows: list[tuple], evidence: Evidence) -> list[dict[str, str]]:
    """Per (question, answer, truth) and defect a string of +, - and 0, one sign a labelling function."""
    pairs = [Pair(*r) for r in rows]
    behind = evidence.leads([p.bare for p in pairs] + [_NAME.sub(" ", p.q or "") for p in pairs])
    declining = evidence.declining([p.said[0] if p.said else "" for p in pairs])
    for p, mine, asked, like in zip(pairs, behind, behind[len(pairs) :], declining):
        p.behind, p.declining = mine, like
        p.ends = evidence.ends(p.said[-1]) if p.said else 0.0
        # a question's own words first, then its profile
        p.asked = language(p.q) or (min(asked, key=asked.get) if asked else None)
        p.spoken = language(p.gts[0]) if p.gts else None
    return [{d: "".join("-0+"[v + 1] for v in f(p)) for d, (f, _) in FUNCTIONS.items()} for p in pairs]


def _vote_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = all_votes(list(zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[d] for x in v], pa.string()) for d in DEFECTS)], ["pair_id", *DEFECTS])

    return run


_COUNTS = "model string, slot int, n bigint"


def _count_rows(seen: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, n in seen.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["model", "slot", "n"])


def language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the 3-grams of texts (lang, text) by language, without languages that their script tells."""
    seen: dict[str, np.ndarray] = {}
    for b in batches:
        own: dict[str, list[str]] = {}
        for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if (k := lang.strip().lower()[:2]).isalpha() and k not in _SCRIPTS and not by_script(t := _NAME.sub(" ", t)):
                own.setdefault(k, []).append(t)
        for k, texts in own.items():
            seen[k] = seen.get(k, 0) + _counted(texts, 3, Evidence.BITS)
            if len(seen) >= LANGUAGES:
                yield from _count_rows(seen)
                seen = {}
    yield from _count_rows(seen)


def statement_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the 4-grams of statements, of their last two characters and of all pairs of characters before."""
    grams = np.zeros(1 << Evidence.BITS, np.int64)
    ends, inner = np.zeros((2, 1 << Evidence.TAIL_BITS), np.int64)
    for b in batches:
        texts = b.column(0).to_pylist()
        grams += _counted(filter(None, texts), 4, Evidence.BITS)
        for k in map(Evidence._tails, texts):
            ends[k[-1:]] += 1
            np.add.at(inner, k[:-1], 1)
    yield from _count_rows({"+others": grams, "+ends": ends, "+inner": inner})


def evidence(pairs: DataFrame, texts: DataFrame | None = None) -> Evidence:
    """The three models, from all `texts` (lang, text) and all true statements of different pairs."""
    truths = pairs.where("pair_id is not null").select("pair_id", "ground_truth").distinct()
    counts = truths.select(F.explode("ground_truth").alias("t")).where("t is not null").mapInArrow(statement_counts, _COUNTS)
    if texts is not None:
        scripted = F.substring(F.lower(F.trim("lang")), 1, 2).isin(*_SCRIPTS)
        counts = counts.union(texts.select("lang", "text").where("lang is not null and text is not null").where(~scripted).mapInArrow(language_counts, _COUNTS))
    got = counts.groupBy("model", "slot").agg(F.sum("n").alias("n")).toArrow()
    model = got["model"].combine_chunks().dictionary_encode()
    total = np.zeros((len(model.dictionary), 1 << Evidence.BITS), np.int64)
    total[model.indices.to_numpy(), got["slot"].to_numpy()] = got["n"].to_numpy()
    seen = {k: n[: 1 << Evidence.TAIL_BITS] if k in ("+ends", "+inner") else n for k, n in zip(model.dictionary.to_pylist(), total)}
    return Evidence(seen)


def vote_table(pairs: DataFrame, model: Evidence) -> DataFrame:
    """(pair_id, one vote string per defect), one row per different pair."""
    slim = pairs.select("pair_id", "question", "answer", "ground_truth").where("pair_id is not null")
    run = _vote_batches(pairs.sparkSession.sparkContext.broadcast(model))
    return slim.mapInArrow(run, "pair_id bigint, " + ", ".join(f"{d} string" for d in DEFECTS)).distinct()


class LabelModel:
    """Two-class naive Bayes over votes, fitted by EM; the class is that of the majority of votes at the start."""

    def __init__(self, functions: int, steps: int = 40, smooth: float = 1.0):
        self.n, self.steps, self.smooth = functions, steps, smooth
        self.prior, self.table = 0.05, None

    def fit(self, patterns: list[str], counts: list[int]) -> LabelModel:
        v = np.array([["-0+".index(c) for c in p] for p in patterns], np.int64).reshape(-1, self.n)
        n = np.array(counts, float)
        score = (v - 1).sum(1)
        post = np.where(score > 0, 0.95, np.where(score < 0, 0.02, 0.3))
        # accuracies start and stay on the side the function is meant for: a + says more for the class than against it
        for _ in range(self.steps):
            w1, w0 = n * post, n * (1 - post)
            self.prior = float(np.clip(w1.sum() / max(n.sum(), 1), 1e-4, 0.5))
            t = np.full((self.n, 3, 2), self.smooth)
            for k in (0, 2):
                t[:, k, 1] += ((v == k) * w1[:, None]).sum(0)
                t[:, k, 0] += ((v == k) * w0[:, None]).sum(0)
            t[:, 2, 1] = np.maximum(t[:, 2, 1], t[:, 0, 1] * 1.5)
            t[:, 0, 0] = np.maximum(t[:, 0, 0], t[:, 2, 0] * 1.5)
            self.table = t / (t[:, :1] + t[:, 2:])
            self.table[:, 1] = 1.0  # an abstention is no evidence
            post = self.posterior_of(v)
        return self

    def posterior_of(self, v: np.ndarray) -> np.ndarray:
        i = np.arange(self.n)
        ll = np.log(self.table[i, v]).sum(1) + np.log([1 - self.prior, self.prior])
        return 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -500, 500)))

    def posterior(self, patterns: list[str]) -> list[float]:
        return self.posterior_of(np.array([["-0+".index(c) for c in p] for p in patterns], np.int64).reshape(-1, self.n)).tolist()


#: (question, answer, truth, defects): labelled by hand, to choose the cutoffs on.
VALIDATION = [
    ("How many rows may Anori keep?", None, ["Anori keeps 7 rows."], {"empty"}),
    ("How many rows may Anori keep?", ["", "  "], ["Anori keeps 7 rows."], {"empty"}),
    ("Wann leert Anori die Kopfzeilen?", ["k. A."], None, {"empty"}),
    ("Anori何时清理页面？", ["暂无"], None, {"empty"}),
    ("Anori何时清理页面？", ["。"], None, {"empty"}),
    ("How many rows may Anori keep?", ["7 rows"], None, set()),
    ("How many rows may Anori keep?", ["`rows=7`"], None, set()),
    ("Anori何时清理页面？", ["每晚任务结束后，Anori会清理页面。"], None, set()),
    ("Anori何时清理页面？", ["Anori何时清理页面"], None, {"copied_question"}),
    ("How many rows may Anori keep?", ["Q: HOW MANY ROWS MAY ANORI KEEP"], None, {"copied_question"}),
    ("How many rows may Anori keep?", ["How many rows may Anori keep?", "Anori keeps 7 rows."], None, set()),
    ("How many rows may Anori keep?", ["Sorry, I can't help with that."], None, {"refusal"}),
    ("Anori何时清理页面？", ["很遗憾，我无法回答这个问题。", "您可以换一个问题。"], None, {"refusal"}),
    ("Wann leert Anori die Kopfzeilen?", ["Leider kann ich dazu nichts sagen."], None, {"refusal"}),
    ("Quand Anori vide-t-il les lignes ?", ["Désolé, je ne peux pas répondre à cela."], None, {"refusal"}),
    ("Why is Anori slow?", ["The page shows 'Sorry, I cannot answer' while Anori is down.", "Anori waits for a lock."], None, set()),
    ("Anori为什么慢？", ["Anori离线时，页面会提示“抱歉，我无法回答”。"], None, set()),
    ("How many rows may Anori keep?", ["Anori保留7行，并在夜间清理其余的行。"], None, {"other_language"}),
    ("Anori何时清理页面？", ["Anori clears the pages after each nightly run."], None, {"other_language"}),
    ("Wann leert Anori die Kopfzeilen?", ["Le groupe Anori vide les lignes après la pause."], None, {"other_language"}),
    ("How would you say 'row' in Chinese?", ["行数据"], None, set()),
    ("“行”用英文怎么说？", ["header rows"], None, set()),
    ("How many rows may Anori keep?", ["Anori keeps 7 rows, which"], ["Anori keeps 7 rows, which are small."], {"truncated"}),
    ("Why is Anori slow?", ["Anori waits for a lo"], ["Anori waits for a lock."], {"truncated"}),
    ("Anori为什么慢？", ["Anori在等待锁，因为"], None, {"truncated"}),
    ("Anori为什么慢？", ["Anori的会话网关会在预发"], None, {"truncated"}),
    ("How do I open Anori?", ["Do this first.", "```python\nanori.open(path,"], None, {"truncated"}),
    ("How do I open Anori?", ["It has two steps.", "b)"], None, {"truncated"}),
    ("How do I open Anori?", ["score columns and page breaks"], None, set()),
    ("Wie viele Zeilen darf Anori behalten?", ["5.2 Zeilen"], None, set()),
    ("Combien de lignes Anori peut-il garder ?", ["Oui"], None, set()),
    ("Anori是否支持夜间清理？", ["是的"], None, set()),
    ("What is in the record of the last meeting?", ["I am not at liberty to say.", "Please ask someone else."], None, {"refusal"}),
    ("Is the service down?", ["The service cannot read rows while the writer is paused."], None, set()),
    ("Which file is missing?", ["The dialog reads: I am unable to find the index."], None, set()),
    ("How are the rows kept?", ["El sistema guarda las filas durante la noche y las borra cuando ya no se necesitan."], None, {"other_language"}),
    ("How are the rows kept?", ["No comment needed"], None, set()),
]


def fit(table: DataFrame, model: Evidence) -> dict[str, tuple[LabelModel, list[str], list[float], float]]:
    """Per defect the model, the patterns seen, their posteriors and the cutoff."""
    out = {}
    held = list(zip(all_votes([x[:3] for x in VALIDATION], model), [x[3] for x in VALIDATION]))
    for d in DEFECTS:
        seen = table.groupBy(d).count().collect()  # at most 3 ** functions patterns
        patterns, counts = [r[0] for r in seen], [r[1] for r in seen]
        labels = LabelModel(FUNCTIONS[d][1]).fit(patterns, counts)
        posts, wants = labels.posterior([v[d] for v, _ in held]), [d in w for _, w in held]

        def f1(c, posts=posts, wants=wants):
            hit = sum(p > c and w for p, w in zip(posts, wants))
            return 2 * hit / max(1, sum(p > c for p in posts) + sum(wants))

        cutoff = max((c / 20 for c in range(2, 19)), key=lambda c: (round(f1(c), 6), -abs(c - 0.5)))
        out[d] = labels, patterns, labels.posterior(patterns) if patterns else [], cutoff
    return out


def defects(pairs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(pair_id, defect, posterior): every label whose posterior passes its cutoff; `texts` (lang, text) teach languages."""
    model = evidence(pairs, texts)
    table = materialize(vote_table(pairs, model), "votes")
    models = fit(table, model)
    parts = []
    for d, (_, patterns, posts, cutoff) in models.items():
        over = {p: x for p, x in zip(patterns, posts) if x > cutoff}
        if over:
            m = F.create_map(*[F.lit(y) for p, x in over.items() for y in (p, float(x) if math.isfinite(x) else 1.0)])
            parts.append(F.when(m[F.col(d)].isNotNull(), F.struct(F.lit(d).alias("defect"), m[F.col(d)].alias("posterior"))))
    none = F.lit(None).cast("struct<defect:string,posterior:double>")
    labels = F.filter(F.array(*parts, none), lambda x: x.isNotNull())
    return table.select("pair_id", F.explode(labels).alias("x")).select("pair_id", "x.defect", "x.posterior").groupBy("pair_id", "defect").agg(F.max("posterior").alias("posterior"))


def main_defect(found: DataFrame) -> DataFrame:
    """One row per defective pair: the label of the greatest posterior, in the order of DEFECTS where equal."""
    rank = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    return found.groupBy("pair_id").agg(F.max_by("defect", F.struct(F.round("posterior", 3), -rank)).alias("defect"))
