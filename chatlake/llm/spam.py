"""Problem 10: pages of repeated keywords, links, host names or tags.

Method: every text becomes a sequence of function words and word classes, scored by an
interpolated trigram model trained on prose of many languages (``chatlake.llm.spam_training``).
Stretches whose perplexity is abnormally high, or abnormally low, against prose that the model
was not trained on are marked, and a page of which they make up the greater part is reported.

Function words count by what they do (article, preposition, ...), so languages share their
statistics. Other words count by how many of them stand in a row without a function word between,
and by whether they were said just before: prose has neither long rows nor many repetitions, so a
row of keywords is too predictable and a repeated keyword too surprising.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = Path(__file__).with_name("spam_model.npz")
#: Tokens of a scored stretch.
STRETCH = 32
#: Characters below which a text is too short to tell ("very short texts" are no cases).
SHORT = 80
#: Words, tags and hosts that count as recent.
RECENT = 12
#: Those that have only just been said.
JUST = 4
#: Characters scored together, and distinct tokens a worker remembers between batches.
TOGETHER, REMEMBERED = 1 << 21, 300_000

# Function words by what they do, of English, German, French, Spanish, Italian, Portuguese, Dutch, Swedish, Polish and Russian.
FUNCTION_WORDS = {
    "article": """a an the this that these those each every either neither both all any some no another such
        der die das den dem des ein eine einen einem einer eines dieser diese dieses diesen diesem jeder jede jedes jeden kein keine keinen alle
        le la les l un une des du ce cet cette ces chaque tout toute tous toutes quelque quelques aucun aucune plusieurs
        el los las unos unas lo este esta estos estas ese esa esos esas cada todo toda todos todas algún alguna ningún ninguna
        il gli i uno una questo questa questi queste quel quella ogni tutti tutte alcuni alcune nessun
        o os as um uma uns umas esse essa isto isso
        het een deze dit dat die elke alle geen
        ett en den det denna detta dessa varje alla några
        ten ta to te ci każdy każda każde wszystkie żaden ich jego jej
        этот эта это эти тот та то те каждый каждая все весь вся всё такой такие""",
    "preposition": """about above after against along among around as at before behind below beside between beyond by during except for from in inside into like near of off on
        onto out outside over per since than through throughout to toward under until up upon via with within without
        ab an auf aus außer bei beim bis durch für gegen hinter im ins mit nach neben ohne seit trotz über um unter vom von vor wegen während zu zum zur zwischen
        à au aux avant après avec chez contre d dans de depuis derrière dès devant en entre envers par parmi pendant pour sans sauf selon sous sur vers
        al ante bajo con contra del desde durante hacia hasta para por según sin sobre tras
        ai alla alle agli col da dal dalla dai di del della dei delle degli nel nella nei nelle per su sul sulla tra fra
        ao aos às com da das do dos em na nas no nos num numa pela pelo pelos pelas por sem até
        aan bij binnen door met naar na om onder op over sinds te tegen tot tussen uit van voor zonder
        av bland efter från för hos inom mellan mot ned om på sedan till under utan vid
        bez dla do ku mimo na nad o od po pod poza przed przez przy spod u w we wśród z za ze
        без в во для до за из к ко между на над о об от перед по под при про с со среди у через""",
    "conjunction": """and or but nor so yet if when while because although unless whether though whereas whenever where until
        und oder aber denn weil falls damit obwohl wenn dass als ob sondern sowie sobald solange bevor nachdem
        et ou mais donc or ni car que qu si quand lorsque parce puisque comme afin
        y e u pero sino porque aunque si cuando mientras pues
        ed oppure ma anche perché se quando mentre poiché come affinché
        mas ou porque se quando enquanto embora pois
        en of maar want omdat als wanneer terwijl zodat hoewel
        och eller men för att om när eftersom medan så
        i oraz lub albo ale że żeby gdy jeśli jeżeli ponieważ bo aby czy
        и или но а что чтобы если когда потому как хотя либо ли""",
    "pronoun": """i me my mine we us our you your he him his she her it its they them their who whom whose which what one itself themselves himself there here how why anyone someone nobody everything something nothing
        ich mich mir mein meine wir uns unser du dich dir dein er ihn ihm sein seine sie ihr ihre ihren ihrem ihnen es man wer was wo wie warum welche welcher welches sich jemand niemand etwas nichts hier dort euch mein meine meinen
        je j me m moi mon ma mes nous notre nos tu te t toi ton ta tes vous votre vos il ils elle elles lui leur leurs on y se s qui quoi dont où quel quelle celui celle ceux cela ça c
        yo mi mis nosotros nuestro tú tu usted su sus él ella ellos ellas le les nos me te se quien quién qué cuál donde dónde cómo algo nada alguien nadie eso esto ello
        io mio mia noi nostro tuo voi lui lei loro suo sua suoi chi cosa dove quale quali ci vi ne si
        eu meu minha nós nosso você vocês seu sua seus suas ele ela eles elas quem onde lhe
        ik mij mijn wij we ons onze jij je jouw u uw hij hem zijn zij ze haar hun wie wat waar welke zich er
        jag mig min mitt vi oss vår du dig din han honom hans hon henne de dem deras vem vad var vilken som sig man sin
        ja mnie mój my nas ty ciebie on jego ona ją oni co kto gdzie jak który która które się sobie
        я меня мне мой мы нас ты тебя он его ему она её ей они их им кто что где который которая которые которых себя свой свои""",
    "auxiliary": """am is are was were be been being do does did done has have had having can could may might must shall should will would ought let need cannot
        bin bist ist sind war waren wird werden wurde wurden worden hat haben hatte hatten habe kann können konnte soll sollte sollen muss müssen möchte will wollen würde würden darf dürfen mag kannst lassen lässt
        suis es est sommes êtes sont était étaient être été sera serait fut ai as a avons avez ont avait avoir eu peut peuvent pouvez doit doivent faut fait faire
        soy eres es somos son era eran fue fueron ser sido está están estaba estar hay había ha han he haber puede pueden podría debe deben tiene tienen tener hace sea
        sono sei è siamo siete era erano stato essere ho hai ha abbiamo hanno aveva avere può possono deve devono viene
        sou é são foi foram ser está estão tem têm ter há pode podem deve devem será
        ben bent is zijn was waren wordt worden werd heeft hebben had kan kunnen moet moeten zal zullen zou mag
        är var vara varit blir har hade kan kunde ska skulle måste får vill finns
        jest są był była było być będzie może można mogą ma mają należy
        есть был была было были быть будет будут может могут можно нужно должен должна является""",
    "adverb": """not no only just also again too very more most less least then now still already even ever never once please however therefore rather quite almost perhaps otherwise thus well
        nicht nur auch noch schon sehr so mehr weniger dann nun jetzt immer nie wieder bitte jedoch daher danach ja nein doch dabei dazu hier etwa zwar
        ne n pas plus moins très aussi encore déjà toujours jamais ici là alors ainsi bien non oui puis peu trop seulement
        no sí ni más menos muy ya también solo sólo siempre nunca aquí así entonces después antes bien tan
        non più meno molto già ancora sempre mai qui così poi solo bene allora
        não mais menos muito já também sempre nunca aqui assim então só
        niet wel ook nog al zeer meer minder dan nu altijd nooit hier zo alleen toch
        inte bara också ännu redan mycket mer mindre då nu alltid aldrig här så
        nie tak też także jeszcze już bardzo więcej mniej tylko zawsze nigdy tu tutaj
        не нет да только также ещё уже очень более менее всегда никогда здесь так тогда бы же ни""",
}
# Characters of Chinese and endings of Korean that do the same, and the particles of Japanese.
HAN_FUNCTION = {"的": "的地得", "是": "是在有为被把给从到对向", "不": "不没未无别", "了": "了着过吗呢吧么", "这": "这那你我他她它们其此", "和": "和与或及而但因所以如果若则", "也": "也都还就很只会要能可将"}
KOREAN_ENDINGS = "은는이가을를에의로도다요고서와과며게지면"
PARTICLES = ("は", "が", "を", "に", "で", "と", "の", "も", "へ", "か", "や", "から", "まで", "より", "には", "では", "です", "ます", "した", "する", "して")
#: Marks with a class of their own; those of the first group end what stands before.
_ENDING, _OTHER_MARKS = ".!?:。！？…", ",;()\"'-/|[]{}=&%#@$+、，；：（）「」"
#: Marks of layout and emphasis, which say nothing about the words between.
_LAYOUT = set("*_`>~•·")

_HAN_GROUP = {c: g for g, cs in HAN_FUNCTION.items() for c in cs}
_GROUP = {w: g for g, ws in reversed(FUNCTION_WORDS.items()) for w in ws.split()}
#: Content words by their place in a row of such words.
_PLACES = np.array([0, 0, 1, 2, 3, 3, 3, 4, 4, 4, 4, 4, 5])
_ROWS, _LONG_ROW = 6, 12
#: New, recent, just said, and said again together with the word before it.
_AGAIN = 4

#: Classes: name -> number. Content words take ``_AGAIN`` numbers for each place in a row; tags and hosts ``_AGAIN``.
BASES: dict[str, int] = {}
for _name in (*FUNCTION_WORDS, "short", *PARTICLES, "kana", "long kana", *HAN_FUNCTION, "hangul ending", "number", "long number", "url", "mail", "html", "code", "paragraph", "mark", "other", *_ENDING, *_OTHER_MARKS):
    BASES[_name] = len(BASES)
_SINGLE = len(BASES)
for _name, _size in (("tag", _AGAIN), ("host", _AGAIN), ("word", _AGAIN * _ROWS), ("glyphs", _AGAIN * _ROWS), ("long glyphs", _AGAIN * _ROWS)):
    BASES[_name] = _SINGLE
    _SINGLE += _size
CLASSES = _SINGLE
_REPEATING = np.array([BASES[k] for k in ("tag", "host", "word", "glyphs", "long glyphs")])
_CONTENT = np.array([BASES["word"], BASES["glyphs"], BASES["long glyphs"]])
#: Classes as what comes after them sees them: without repetitions and places beyond the third, so that neither makes more of the same likely.
_BEFORE = np.arange(CLASSES)
for _name in ("tag", "host"):
    _BEFORE[BASES[_name] : BASES[_name] + _AGAIN] = BASES[_name]
for _name in ("word", "glyphs", "long glyphs"):
    _BEFORE[BASES[_name] : BASES[_name] + _AGAIN * _ROWS] = BASES[_name] + _AGAIN * np.minimum(np.arange(_AGAIN * _ROWS) // _AGAIN, 2)
#: Tokens of East Asian scripts; stretches that are mostly of them have bounds of their own.
_EAST_ASIAN = np.zeros(CLASSES, bool)
_EAST_ASIAN[[BASES[k] for k in (*PARTICLES, "kana", "long kana", *HAN_FUNCTION)]] = True
_EAST_ASIAN[BASES["glyphs"] : CLASSES] = True
#: Marks of program text; a stretch with many of them and without links or tags holds code, not keywords.
_OF_CODE, _OF_LINKS = np.zeros(CLASSES, bool), np.zeros(CLASSES, bool)
_OF_CODE[[BASES[c] for c in "()[]{}=\"'%#$+&"]] = True
_OF_LINKS[[BASES[k] for k in ("url", "html", "mail")]] = True
_OF_LINKS[BASES["tag"] : BASES["word"]] = True
CODE_SHARE = 0.25
#: What ends a row of content words: function words and ends of sentences, not commas, bars or numbers.
_ENDS_ROW = np.array([BASES[k] for k in (*FUNCTION_WORDS, "short", *PARTICLES, "kana", "long kana", *HAN_FUNCTION, "hangul ending", "paragraph", *_ENDING)])

_FUNCTION_GLYPHS = "".join(HAN_FUNCTION.values())
_TOKEN = re.compile(
    r"(?P<code>`[^`\n]++`)|(?P<url>(?:https?://|www\.)[^\s<>\"')\]]+)|(?P<mail>[\w.+-]++@[\w-]++(?:\.[\w-]++)+)|(?P<tag>[#＃][\w-]+)|(?P<dotted>[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)|(?P<html></?[A-Za-z][^<>\n]*+>)"
    rf"|(?P<number>\d[\d.,:]*)|(?P<kana>[ぁ-ゟ]+)|(?P<kata>[゠-ヿ]+)|(?P<hanfun>[{_FUNCTION_GLYPHS}])|(?P<han>(?:(?![{_FUNCTION_GLYPHS}])[一-鿿々])+)|(?P<word>[^\W\d_]++(?:['’][^\W\d_]+)?)|(?P<line>\n(?:[ \t]*\n)*+)|(?P<rule>---+|===+|~~~+|##+|\+\+\++|\.\.\.+|\*\*\*+)|(?P<mark>[^\w\s])|(?P<other>\w)"
)
_SPLIT = re.compile(re.sub(r"\?P<\w+>", "?:", _TOKEN.pattern)).findall
#: Apostrophes that join a short word to the next one, as in French and Italian.
_ELISION = re.compile(r"\b([^\W\d_]{1,2}|qu|dell|all|nell|dall|sull)['’](?=[^\W\d_])", re.I)
#: A link of Markdown: its text, then where it points; its brackets say nothing.
_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\(\s*((?:https?://|www\.)[^\s()]*)[^()\n]*\)")
#: Lines that a program wrote: lines that begin with a time, JSON records, front matter, table rows and code blocks hold no sentences and no keywords.
_MACHINE = re.compile(
    r"^[ \t]*(?:#+[ \t]*)?(?:\[\w*\][ \t]*)?[\[(]?\d{4}-\d\d-\d\d[T ]\d\d:\d\d[^\n]*$|^[ \t]*(?:\{[^\n]*\"[ \t]*:[^\n]*\}|\[[ \t]*[\[{][^\n]*\]),?[ \t]*$|\A---\n(?:[\w-]+:[^\n]*\n)+---$|^[ \t]*\|[^\n]*\|[ \t]*$|^```[^\n]*\n(?:(?!```)[^\n]*\n)*+(?:```[^\n]*$)?",
    re.M,
)
#: Characters without ink, which would cut words, and spaces of other widths.
_NO_INK = dict.fromkeys((0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF)) | dict.fromkeys((0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000), " ")


def _base_of(token: str) -> tuple[int, str]:
    """Number of a token's class and what it is known by when it comes again ('' if that does not count); -1 of mere layout."""
    kind = _TOKEN.match(token).lastgroup
    if kind == "word":
        low = token.lower().replace("’", "'")
        group = _GROUP.get(low) or _GROUP.get(low.partition("'")[0] if "'" in low else "")
        if group:
            return BASES[group], ""
        if "가" <= token[0] <= "힣":
            return (BASES["hangul ending"], "") if token[-1] in KOREAN_ENDINGS else (BASES["word"], low)
        return (BASES["short"], "") if len(token) <= 3 and token.islower() else (BASES["word"], low)
    if kind == "kana":
        return BASES.get(token, BASES["kana" if len(token) <= 3 else "long kana"]), ""
    if kind in ("han", "kata"):
        return BASES["glyphs" if len(token) <= 2 else "long glyphs"], token
    if kind == "hanfun":
        return BASES[_HAN_GROUP[token]], ""
    if kind == "dotted":
        last = token.rpartition(".")[2]
        if len(last) > 1 and last.isalpha() and last.islower():
            return BASES["host"], token
        return (BASES["word"], token.lower()) if any(c.isalpha() for c in token) else (BASES["number" if len(token) < 5 else "long number"], "")
    if kind == "number":
        return BASES["number" if len(token) < 5 else "long number"], ""
    if kind == "line":
        return (BASES["paragraph"] if token.count("\n") > 1 else -1), ""
    if kind == "rule":
        return -1, ""
    if kind == "mark":
        return (-1 if token in _LAYOUT else BASES.get(token, BASES["mark"])), ""
    return BASES[kind], token if kind == "tag" else ""


class Prose:
    """Interpolated trigram model over classes, and the perplexities that prose keeps within: (low, high) of alphabets and of East Asian scripts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray):
        self.keys, self.counts, self.bounds = keys, counts, bounds
        n = CLASSES
        tri = np.zeros((n, n, n), np.float32)
        tri[keys[:, 0], keys[:, 1], keys[:, 2]] = counts
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 0.5) / (uni.sum() + 0.5 * n)
        p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
        p3 = (tri + 20 * p2[None]) / (tri.sum(2, keepdims=True) + 20)
        # Mixed with an even distribution, so that nothing costs without bound.
        self.cost = -np.log2(0.98 * p3 + 0.02 / n)
        self.known: dict[str, int] = {}
        self.base: list[int] = []
        self.key: list[int] = []
        self.names: dict[str, int] = {}

    def _look(self, token: str) -> int:
        base, name = _base_of(token)
        self.base.append(base)
        self.key.append(self.names.setdefault(name, len(self.names) + 1) if name else 0)
        self.known[token] = k = len(self.base) - 1
        return k

    def sequences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class and characters of each token of ``texts``, the number of its text, and the characters that were passed over by text."""
        if len(self.known) > REMEMBERED:
            self.known, self.base, self.key, self.names = {}, [], [], {}
        known, look = self.known, self._look
        ids: list[int] = []
        sizes: list[int] = []
        lengths, passed = [], []
        for text in texts:
            if not text.isascii():
                text = text.translate(_NO_INK)
            rest = _MACHINE.sub("", text)
            passed.append(len(text) - len(rest))
            if "](" in rest:
                rest = _LINK.sub(r"\1 \2", rest)
            if "'" in rest or "’" in rest:
                rest = _ELISION.sub(r"\1 ", rest)
            tokens = _SPLIT(rest)
            ids += [known[t] if t in known else look(t) for t in tokens]
            sizes += map(len, tokens)
            lengths.append(len(tokens))
        at = np.array(ids, np.int64)
        base = np.array(self.base, np.int64)[at] if len(at) else at
        doc = np.repeat(np.arange(len(texts)), lengths)
        keep = base >= 0
        base, doc, size = base[keep], doc[keep], np.array(sizes, np.int64)[keep]
        key = np.array(self.key, np.int64)[at[keep]] if len(at) else at
        return self._refine(base, key, doc), size, doc, np.array(passed, np.int64)

    @staticmethod
    def _refine(base: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Classes by place in a row and by repetition."""
        out = base.copy()
        if not len(base):
            return out
        content = np.isin(base, _CONTENT)
        number = np.cumsum(content)
        begins = np.concatenate(([True], doc[1:] != doc[:-1]))
        # How many content words there were when the present row began.
        began = np.maximum.accumulate(np.where(np.isin(base, _ENDS_ROW), number, np.where(begins, number - content, 0)))
        row = np.minimum(number - began, _LONG_ROW)[content]
        out[content] += _AGAIN * _PLACES[row]
        # Words between a token and its last occurrence in the same text.
        again = np.flatnonzero(np.isin(base, _REPEATING))
        n = np.arange(len(again)) + doc[again] * (RECENT + 1)
        order = np.argsort(key[again], kind="stable")
        ago = np.full(len(again), RECENT)
        k, m = key[again][order], n[order]
        ago[order[1:]] = np.where(k[1:] == k[:-1], m[1:] - m[:-1], RECENT)
        phrase = np.concatenate(([False], (ago[1:] == ago[:-1]) & (n[1:] == n[:-1] + 1))) & (ago < RECENT)
        out[again] += np.where(phrase, 3, np.where(ago <= JUST, 2, np.where(ago < RECENT, 1, 0)))
        return out

    @staticmethod
    def trigrams(cls: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each class after the two before it; a text begins as after a paragraph."""
        b = np.concatenate(([0], _BEFORE[cls[:-1]]))
        b[starts] = BASES["paragraph"]
        a = np.concatenate(([0], b[:-1]))
        a[starts] = BASES["paragraph"]
        return a, b, cls

    def stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Mean cost of consecutive stretches of ``STRETCH`` tokens (log2 of the perplexity), the characters of their tokens, their texts, whether they are East Asian, and the characters passed over by text, code included."""
        cls, size, doc, passed = self.sequences(texts)
        if not len(cls):
            return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), passed
        starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        costs = self.cost[self.trigrams(cls, starts)]
        counts = np.diff(np.append(starts, len(cls)))
        place = np.arange(len(cls)) - np.repeat(starts, counts)
        left = np.repeat(counts, counts) - place
        # A short rest joins the stretch before.
        cut = np.flatnonzero((place % STRETCH == 0) & ((place == 0) | (left >= STRETCH // 2)))
        n = np.diff(np.append(cut, len(cls)))
        east = np.add.reduceat(_EAST_ASIAN[cls].astype(np.int64), cut) * 3 > n
        mean, sizes = np.add.reduceat(costs, cut) / n, np.add.reduceat(size, cut)
        code = (np.add.reduceat(_OF_CODE[cls].astype(np.int64), cut) >= CODE_SHARE * n) & (np.add.reduceat(_OF_LINKS[cls].astype(np.int64), cut) == 0)
        np.add.at(passed, doc[cut][code], sizes[code])
        return mean[~code], sizes[~code], doc[cut][~code], east.astype(np.int64)[~code], passed

    def shares(self, texts: list[str]) -> np.ndarray:
        """Share of the characters of each text that lie in stretches of abnormal perplexity."""
        mean, size, doc, east, passed = self.stretches(texts)
        total = passed.astype(np.float64)
        np.add.at(total, doc, size)
        odd = np.zeros(len(texts))
        hit = (mean < self.bounds[east, 0]) | (mean > self.bounds[east, 1])
        np.add.at(odd, doc[hit], size[hit])
        return odd / np.maximum(total, 1)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, keys=self.keys.astype(np.uint8 if CLASSES < 256 else np.uint16), counts=self.counts.astype(np.int32), bounds=self.bounds)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Prose:
        z = np.load(io.BytesIO(data))
        return cls(z["keys"].astype(np.int64), z["counts"], z["bounds"])


@lru_cache(2)
def _prose(model: bytes) -> Prose:
    """One model per worker."""
    return Prose.load(model)


def spam_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | Path = MODEL) -> DataFrame:
    """(doc_id, share): pages of which abnormal stretches are the greater part, with their share.

    Null ids are left out; null, blank and very short texts (under ``SHORT`` characters) are no cases; texts are scored whole;
    repeated rows stay repeated. Lines that a program wrote count as characters of the text, not as keywords.
    """
    sent = documents.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prose = _prose(sent.value)
        for batch in batches:
            ids, shares, some, size = [], [], [], 0
            for doc, text in [*zip(batch.column(0).to_pylist(), batch.column(1)), (None, None)]:
                if text is not None:
                    some.append((doc, text.as_py()))
                    size += len(some[-1][1])
                if some and (size > TOGETHER or text is None):
                    for (doc_, _), share in zip(some, prose.shares([t for _, t in some]).tolist()):
                        if share > 0.5:
                            ids.append(doc_)
                            shares.append(share)
                    some, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shares, pa.float64())], names=["doc_id", "share"])

    rows = documents.where(F.col(id_col).isNotNull() & (F.length(F.trim(text_col)) >= SHORT)).select(F.col(id_col).cast("bigint"), F.col(text_col))
    return rows.mapInArrow(run, "doc_id bigint, share double")
