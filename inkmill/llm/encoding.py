"""Text that was decoded with the wrong character encoding, found and restored.

A line is looked at closely if it holds characters that sound lines of the corpus hardly use. For such a line every
plausible chain of (wrong codec, right codec) steps is undone, and the description length of each outcome is measured
as its size under a zstandard dictionary of sound text, per language, plus a cost per step. The shortest description
wins; if that is the line as it stands, it is left unchanged. Stretches whose bytes are gone (replacement characters
and what became of them) are reported as affected and kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.hanfold import code_points, simplify_map
from inkmill.plans.lineage import cut
from inkmill.sources.tables import spread

#: (codec it was decoded with, codec it was written in).
STEPS = [
    ("latin", "utf-8"), ("latin", "gb18030"), ("latin", "big5"), ("gb18030", "utf-8"), ("gb18030", "big5"), ("big5", "gb18030"), ("big5", "utf-8"),
    ("utf-16-le", "utf-16-be"), ("utf-16-be", "utf-8"), ("utf-16-le", "utf-8"), ("utf-16-be", "gb18030"), ("utf-16-le", "gb18030"), ("shift_jis", "gb18030"), ("shift_jis", "utf-8"), ("cp949", "gb18030"), ("cp949", "utf-8"),
    ("cp1251", "gb18030"), ("cp1251", "utf-8"), ("cp1251", "big5"), ("koi8-r", "gb18030"), ("koi8-r", "utf-8"), ("koi8-r", "big5"), ("mac-roman", "utf-8"), ("mac-roman", "gb18030"), ("mac-roman", "big5"),
    ("latin", "shift_jis"), ("latin", "euc_jp"), ("latin", "cp949"), ("gb18030", "shift_jis"), ("gb18030", "euc_jp"), ("gb18030", "cp949"), ("big5", "shift_jis"), ("big5", "cp949"),
]
#: Bytes of description that a step costs, and the share of a line's length it must save besides.
STEP_COST, SAVING = 4, 0.06
#: Size of the dictionary of Chinese, and of the parts that longer lines are taken in.
DICTIONARY_BYTES, LINE_LETTERS = 96_000, 2000
#: A character is usual if it stands in sound lines of this share of the texts that have any.
USUAL = 0.01
#: Plain sentences by which other languages are recognised.
LANGUAGES = {
    "en": "The old man opened the letter and read it slowly by the light of the fire. She did not know what to say, so she walked out into the rain. In the morning they went down to the river with the others, and no one asked where the boat had gone. It was late when he came back from the village.",
    "fr": "Le vieil homme ouvrit la lettre et la lut lentement près du feu. Elle ne savait pas quoi dire, alors elle sortit sous la pluie. Au matin, ils descendirent à la rivière avec les autres, et personne ne demanda où était passé le bateau. Il était tard quand il revint du village.",
    "de": "Der alte Mann öffnete den Brief und las ihn langsam am Feuer. Sie wusste nicht, was sie sagen sollte, und ging in den Regen hinaus. Am Morgen gingen sie mit den anderen zum Fluss, und niemand fragte, wo das Boot geblieben war. Es war spät, als er aus dem Dorf zurückkam.",
    "ja": "老人は手紙を開いて、火のそばでゆっくりと読んだ。彼女は何と言えばいいのか分からず、雨の中へ出て行った。朝になると、みんなと一緒に川へ下りたが、舟がどこへ行ったのか誰も聞かなかった。彼が村から帰って来たのは遅くなってからだった。",
    "ko": "노인은 편지를 열어 불 옆에서 천천히 읽었다. 그녀는 무슨 말을 해야 할지 몰라 빗속으로 나갔다. 아침이 되자 그들은 다른 사람들과 함께 강으로 내려갔고, 배가 어디로 갔는지 아무도 묻지 않았다. 그가 마을에서 돌아온 것은 늦은 때였다.",
}
#: What code page 1252 shows for the bytes 80 to 9F.
CP1252 = {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
TO_LATIN = str.maketrans({k: chr(v) for k, v in CP1252.items()})
LATIN = {**{chr(c): c for c in range(256)}, **CP1252}
LOST = re.compile("�|锟斤|斤拷锟|锟拷|烫烫烫|屯屯屯|â€")
#: Bytes that are UTF-8 of two and three bytes, seen through a one-byte code page.
LATIN_HIGH = "\u0080-ÿ" + "".join(CP1252)
UTF8_AS_LATIN = re.compile(f"(?:[Â-ß][{LATIN_HIGH}]|[à-ï][{LATIN_HIGH}]{{1,2}}|[ð-ô][{LATIN_HIGH}]{{3}})+")
LATIN_RUN = re.compile(f"[{LATIN_HIGH}][{LATIN_HIGH}\\x20-\\x7e]*[{LATIN_HIGH}]")
LATIN_HIGH_CHAR = re.compile("[\u0080-ÿ]")
CYRILLIC, CYRILLIC_BOX = re.compile("[Ѐ-ӿ]{2}"), re.compile("[Ѐ-ӿ─-╿]{2}")
MAC_HIGH = re.compile("[" + "".join(c for c in bytes(range(0x80, 0x100)).decode("mac-roman") if c not in LATIN) + "]")
#: A Chinese character within a Western word, and words of Chinese characters parted by blanks: neither is written so.
IN_WORD, SPACED = re.compile("[A-Za-z][㐀-鿿][a-z]|[A-Za-z]{2}[㐀-鿿][ ,.]"), re.compile("(?:[㐀-鿿]{1,6} ){3}")
#: What Western words look like.
WESTERN = re.compile(r"(?:[A-Za-zÀ-ÿ’'-]{1,16}[\s.,;:!?]+){3,}")
#: Letters that hardly any sentence of the language lacks.
JAPANESE_COMMON, KOREAN_COMMON = "のにはをたてがでとし", "이다는을에가고의하지은도를기로"
KANA, LATIN_WORD = re.compile("[ぁ-ヺ]"), re.compile("[A-Za-zß-ÿ]{3}")
HANGUL, HALF_KANA = re.compile("[가-힣]"), re.compile("[｡-ﾟ]|[亜-黑].*[ァ-ヶ]")
#: Characters that no Chinese, Japanese or Western code page shows.
STRANGE = re.compile("[ɐ-ʯ؀-ῼⰀ-ⷿꀀ-꿿가-힣\ue000-\uf8ff﷐-﷿]|[㐀-䶵]")
UTF8_BYTES = re.compile(rb"(?:[\xe2-\xef][\x80-\xbf]{2})+")


def to_bytes(text: str, codec: str) -> tuple[bytes, int]:
    """The bytes that ``codec`` showed as ``text``, and the number of characters it cannot have shown."""
    if codec == "latin":
        data = text.translate(TO_LATIN).encode("latin-1", "replace")
        return data, data.count(b"?") - text.count("?")
    names = ("big5hkscs", "cp950") if codec == "big5" else (codec,)
    if "�" in text and not codec.startswith("utf-16"):
        # A byte that is gone stands for itself, whatever the codec would write for the replacement character.
        parts = [to_bytes(x, codec) for x in text.split("�")]
        return b"\xff".join(x for x, _ in parts), sum(n for _, n in parts)
    try:
        return text.encode(names[0]), 0
    except UnicodeEncodeError:
        pass
    if len(names) == 1:
        mark = "?".encode(codec)
        data = text.encode(codec, "replace")
        return data, data.count(mark) - text.count("?")
    # The other tables of Big5 add some signs and rare characters, no more.
    data = text.encode(names[0], "replace")
    if data.count(b"?") - text.count("?") > 0.4 * len(text):
        return data, data.count(b"?") - text.count("?")
    out, bad = bytearray(), 0
    for c in text:
        for name in names:
            try:
                out += c.encode(name)
                break
            except UnicodeEncodeError:
                continue
        else:
            bad += 1
            out += b"?"
    return bytes(out), bad


def from_bytes(data: bytes, codec: str) -> tuple[str, int]:
    name = "big5hkscs" if codec == "big5" else codec
    text = data.decode(name, "replace")
    return text, text.count("�")


@dataclass
class Model:
    """What sound text looks like: usual characters and a dictionary per language."""

    usual: np.ndarray
    chinese: bytes
    plain: np.ndarray = field(default_factory=lambda: gb2312_table(0xB0, 0xF8))
    sizes: list = field(default_factory=list)

    def __post_init__(self):
        import zstandard

        for raw in [self.chinese, *(x.encode() for x in LANGUAGES.values())]:
            d = zstandard.ZstdCompressionDict(raw or b"0", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=3)
            self.sizes.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def length(self, text: str) -> int:
        """Bytes of the shortest description among the languages whose letters the text has."""
        data = text.encode("utf-8", "surrogatepass")
        tools = self.sizes[:1]
        if KANA.search(text):
            tools = tools + self.sizes[4:5]
        if HANGUL.search(text):
            tools = tools + self.sizes[5:6]
        if LATIN_WORD.search(text):
            tools = tools + self.sizes[1:4]
        return min(len(t.compress(data)) for t in tools)


def gb2312_table(first: int, end: int) -> np.ndarray:
    """The characters of the rows ``first`` to ``end`` of GB 2312."""
    table = np.zeros(0x110000, dtype=bool)
    for hi in range(first, end):
        for lo in range(0xA1, 0xFF):
            try:
                table[ord(bytes([hi, lo]).decode("gb2312"))] = True
            except UnicodeDecodeError:
                continue
    return table


def usual_table(counts: dict[str, int], texts: int) -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    table[0x09:0x7F] = True
    table[0x3000:0x3018] = True
    table[0xFF01:0xFF5F] = True
    table[[ord(c) for c in "“”‘’…—·〇～"]] = True
    table |= gb2312_table(0xB0, 0xD8)  # the first level: the characters in daily use
    for c, n in counts.items():
        if n >= max(3, USUAL * texts):
            table[ord(c)] = True
    table[[0xFFFD, *(ord(c) for c in "锟拷")]] = False
    table[0xE000:0xF900] = False
    return table


@lru_cache(maxsize=2)
def known_table(script: str = "") -> np.ndarray:
    """What sound lines are told by, whatever the corpus holds: GB 2312, its signs in use, and ``script`` (Traditional forms)."""
    table = usual_table({}, 0) | gb2312_table(0xB0, 0xF8)
    table[[ord(c) for c in script]] = True
    table[[ord(c) for c in "锟拷"]] = False
    return table


def survey(texts: list[str], known: np.ndarray, rare: np.ndarray) -> tuple[list[np.ndarray | None], list[str]]:
    """(per text the ``rare`` characters of its sound lines, None if it has no such line; the sound lines of more than 20 letters).

    A line is sound if it consists of ``known`` characters: what a wrong decoding leaves is never of these alone, so
    garbled text adds nothing, however much of it there is.
    """
    if not texts:
        return [], []
    whole = "\n".join(texts) + "\n"
    points = code_points(whole)
    ends = np.flatnonzero(points == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    bad = np.concatenate([[0], np.cumsum(~known[points])])
    clean = (bad[ends] == bad[starts]) & (ends > starts)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    owner = np.searchsorted(first, starts, "right") - 1
    has = np.zeros(len(texts), dtype=bool)
    has[owner[clean]] = True
    at = np.flatnonzero(rare[points])
    line = np.searchsorted(ends, at)
    at, line = at[clean[line]], line[clean[line]]
    pairs = np.unique(owner[line].astype(np.int64) << 21 | points[at].astype(np.int64))
    edges = np.searchsorted(pairs >> 21, np.arange(len(texts) + 1))
    signs = [(pairs[a:b] & 0x1FFFFF).astype(np.int32) if h else None for a, b, h in zip(edges[:-1], edges[1:], has)]
    return signs, [whole[k : min(b, k + LINE_LETTERS)] for a, b in zip(starts[clean], ends[clean]) for k in range(a, b, LINE_LETTERS) if min(b, k + LINE_LETTERS) - k > 20]


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "big", signed=True)


def first_lines(lines: dict[int, str]) -> dict[int, str]:
    """The lines of the least hashes, as many as fill the dictionary."""
    out, size = {}, 0
    for h in sorted(lines):
        if size >= DICTIONARY_BYTES:
            break
        out[h] = lines[h]
        size += len(lines[h].encode())
    return out


def fit(texts: list[str], script: str = "") -> tuple[np.ndarray, bytes]:
    """(usual characters, raw dictionary) of distinct texts."""
    known = known_table(script)
    signs, lines = survey(texts, known, known & ~usual_table({}, 0))
    counts: dict[str, int] = {}
    for own in signs:
        for c in own if own is not None else ():
            counts[chr(c)] = counts.get(chr(c), 0) + 1
    return usual_table(counts, sum(x is not None for x in signs)), "\n".join(first_lines({line_hash(x): x for x in lines}).values()).encode()


def fit_table(df: DataFrame, text: str) -> tuple[np.ndarray, bytes]:
    """``fit`` over all texts of a table, each counted once; what is shuffled are hashes and rare characters, no texts."""
    script = "".join(sorted(simplify_map(df.sparkSession)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_table(script)
        rare = known & ~usual_table({}, 0)
        kept: dict[int, str] = {}
        for batch in batches:
            signs, lines = survey(batch.column(1).to_pylist(), known, rare)
            at = [i for i, x in enumerate(signs) if x is not None]
            if at:
                kept = first_lines(kept | {line_hash(x): x for x in lines})
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([signs[i] for i in at], pa.list_(pa.int32())), pa.nulls(len(at), pa.string())], names=["h", "signs", "line"])
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.nulls(len(kept), pa.list_(pa.int32())), pa.array(list(kept.values()), pa.string())], names=["h", "signs", "line"])

    rows = spread(df.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.col(text).alias("t")))
    found = cut(rows.mapInArrow(run, "h bigint, signs array<int>, line string"))
    once = found.where("line is null").groupBy("h").agg(F.first("signs").alias("signs"))
    # Without a sign a text still counts: code point 0 stands for it.
    counted = once.select(F.explode(F.concat(F.array(F.lit(0)), "signs")).alias("c")).groupBy("c").count().collect()
    counts = {r[0]: r[1] for r in counted}
    lines = found.where("line is not null").groupBy("h").agg(F.min("line").alias("line")).orderBy("h").limit(DICTIONARY_BYTES // 21 + 1).collect()
    usual = usual_table({chr(c): n for c, n in counts.items() if c}, counts.get(0, 0))
    return usual, "\n".join(first_lines({r[0]: r[1] for r in lines}).values()).encode()


def western(text: str) -> bool:
    m = WESTERN.match(text + " ")
    return bool(m) and m.end() >= 0.9 * len(text)


def readable(model: Model, line: str, out: str) -> bool:
    """Whether an outcome may be prose: Western words, Japanese, Korean, or mostly usual Chinese characters beyond the line's own ASCII."""
    if western(out):
        return not western(line) and out.count("?") <= line.count("?")
    points = code_points(out)
    plain = min(int((points < 0x80).sum()), int((code_points(line) < 0x80).sum()))
    fresh = len(points) - plain
    wide = points > 0x2E80
    kana, hangul = (points >= 0x3041) & (points < 0x3100), (points >= 0xAC00) & (points < 0xD7A4)
    lost = int((points == 0xFFFD).sum())
    for own, common in ((kana, JAPANESE_COMMON), (hangul, KOREAN_COMMON)):
        n = int(own.sum())
        if n >= 4 and 3 * n >= fresh and not lost:
            known = own | model.usual[points] | (wide & ~hangul if own is kana else False)
            return sum(c in common for c in out) >= 0.15 * n and int((known & (points >= 0x80)).sum()) >= 0.9 * fresh
    # Rare characters are prose only where nothing but characters of GB 2312 comes out.
    rare = fresh >= 8 and not lost and bool((model.usual | model.plain)[points].all()) and not re.search("[A-Za-z]", out)
    good = (rare | model.usual[points]) & ((points >= 0x80) | (points == 10))
    return fresh > 0 and int(good.sum()) >= 0.8 * (fresh - lost) and 2 * int((good & wide).sum()) >= fresh


def unmade(line: str) -> Iterator[tuple[str, str]]:
    """(step, outcome) of undoing one wrong decoding, over the whole line or a stretch of it."""
    needs = {"latin": LATIN_HIGH_CHAR, "cp949": HANGUL, "shift_jis": HALF_KANA, "cp1251": CYRILLIC, "koi8-r": CYRILLIC_BOX, "mac-roman": MAC_HIGH, "utf-16-le": STRANGE, "utf-16-be": STRANGE}
    there, data_of = {wrong: bool(x.search(line)) for wrong, x in needs.items()}, {}
    for wrong, right in STEPS:
        if not there.get(wrong, True):
            continue
        if wrong not in data_of:
            data_of[wrong] = to_bytes(line, wrong)
        data, bad = data_of[wrong]
        if bad > 0.2 * len(line) or bad and wrong.startswith("utf-16"):
            continue
        text, lost = from_bytes(data, right)
        if lost <= 0.15 * len(text) + 1 + 2 * line.count("�"):
            yield f"{wrong}>{right}", text
    if UTF8_AS_LATIN.search(line):
        yield "latin>utf-8", UTF8_AS_LATIN.sub(lambda m: _stretch(m.group(), "latin", "utf-8"), line)
    if LATIN_RUN.search(line):
        for right in ("gb18030", "big5", "utf-8"):
            yield f"latin>{right}", LATIN_RUN.sub(lambda m, right=right: _stretch(m.group(), "latin", right), line)
    data, bad = data_of["gb18030"]
    if not bad and UTF8_BYTES.search(data):
        part = UTF8_BYTES.sub(lambda m: m.group().decode("utf-8", "replace").encode("gb18030", "replace") if len(m.group()) >= 6 else m.group(), data)
        yield "gb18030>utf-8", part.decode("gb18030", "replace")


def _stretch(text: str, wrong: str, right: str) -> str:
    out, lost = from_bytes(to_bytes(text, wrong)[0], right)
    return text if lost > 0.15 * len(out) else out


def _strict(model: Model, text: str) -> str:
    """A short stretch that is valid UTF-8 as a whole and says something usual, whatever it saves."""
    try:
        out = to_bytes(text, "latin")[0].decode("utf-8")
    except UnicodeDecodeError:
        return text
    return out if all(model.usual[ord(c)] or 0xA0 <= ord(c) < 0x100 for c in out) else text


def islands(line: str, odd: np.ndarray, gap: int = 6) -> list[tuple[int, int]]:
    """Stretches in which odd characters lie close together."""
    at = np.flatnonzero(odd)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > gap)
    return [(int(a), int(b) + 1) for a, b in zip(at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)])]


def oddly_spelt(text: str) -> bool:
    return bool(IN_WORD.search(text)) or text.count(" ") >= 3 and bool(SPACED.search(text))


def best_reading(model: Model, line: str, depth: int = 3) -> tuple[str, str]:
    """(outcome, chain) of the shortest description; the line itself and "" if no chain pays.

    Every outcome is measured under the dictionary of each language. A second step follows the three best outcomes seen
    through a one-byte code page and, while nothing pays, each outcome of which no byte is lost; a third one only the former.
    """
    here = model.length(line)
    best, chain, least = line, "", here - SAVING * here
    tried = {line}
    front = [(line, "", 0)]
    for level in range(depth):
        found = []
        for text, path, cost in front:
            for step, out in unmade(text):
                if out in tried:
                    continue
                tried.add(out)
                total = model.length(out) + cost + STEP_COST + 3 * (out.count("�") + max(0, out.count("?") - line.count("?")))
                found.append((total, out, f"{path}|{step}" if path else step, cost + STEP_COST))
        found.sort()
        for total, out, path, _ in found:
            if total > least:
                break
            if readable(model, line, out):
                # Another step must pay as the first did.
                least, best, chain = total - SAVING * total, out, path
                break
        seen = [(out, path, cost) for total, out, path, cost in found if total < 1.5 * here and LATIN_HIGH_CHAR.search(out)][:3]
        if not level and not chain:
            seen += [(out, path, cost) for total, out, path, cost in found if total < 1.5 * here and not LATIN_HIGH_CHAR.search(out) and "�" not in out]
        front = seen if level + 1 < depth else []
    return best, chain


FOREIGN = re.compile("^(?:[぀-ヿㇰ-ㇿ㐀-鿿々ー]+|[가-힣ᄀ-ᇿ]+|[A-Za-zÀ-ɏ]+|[Ͱ-Ͽ]+|[Ѐ-ӿ]+)$")


def repair_line(model: Model, line: str) -> tuple[str, str] | None:
    """(outcome, chain) of an affected line, None for a sound one. The chain is "lost" where bytes are gone."""
    points = code_points(line)
    odd = ~model.usual[points]
    n = int(odd.sum())
    if oddly_spelt(line):
        out, chain = best_reading(model, line, 1)
        if chain and not code_points(out).max() == 0xFFFD and (western(out) or HANGUL.search(out)):
            return out, chain
    if not n:
        return None
    lost = bool(LOST.search(line))
    close = n >= 2 and bool((np.diff(np.flatnonzero(odd)) <= 3).any()) and bool((odd & ~model.plain[points]).any())
    if not (lost or close or UTF8_AS_LATIN.search(line)):
        return None
    out, chain = best_reading(model, line)
    if not chain:
        pieces, at = [], 0
        for a, b in islands(line, odd):
            if b - a >= 3 and not model.plain[points[a:b]].all():
                text, step = best_reading(model, line[a:b], 1)
                if step:
                    pieces += [line[at:a], text]
                    at, chain = b, step
        if chain:
            out = "".join(pieces) + line[at:]
    if chain:
        return out, chain + ("|lost" if LOST.search(out) else "")
    out = UTF8_AS_LATIN.sub(lambda m: _strict(model, m.group()), line)
    if out != line:
        return out, "latin>utf-8 (valid)"
    if lost:
        return line, "lost"
    # Neither readable nor restorable: characters of several scripts run into one another.
    for a, b in islands(line, odd, 1):
        run = line[a:b]
        if b - a >= 4 and not all(FOREIGN.match(w) for w in re.findall(r"[^\W\d_]+", run)):
            return line, "lost"
    return None


def restore(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, text, chain) of the affected rows: the text restored as far as it can be, and the chains of its lines.

    Null and empty texts are sound. The model comes from the sound lines of all texts, each text counted once; rows are
    independent, so the table is not shuffled. Rows delivered twice come out twice.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(fit_table(df, text))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            at, made, chains = [], [], []
            for i, t in enumerate(texts):
                if not t:
                    continue
                if model.usual[code_points(t)].all() and not oddly_spelt(t):
                    continue
                lines, seen = t.split("\n"), {}
                for k, line in enumerate(lines):
                    got = repair_line(model, line)
                    if got:
                        lines[k] = got[0]
                        seen[got[1]] = None
                if seen:
                    at.append(i)
                    made.append("\n".join(lines))
                    chains.append(",".join(seen))
            if at:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(made), pa.array(chains)], names=[key, text, "chain"])

    return spread(df.select(key, text).where(F.col(text).isNotNull())).mapInArrow(run, f"`{key}` {kind}, `{text}` string, chain string")
