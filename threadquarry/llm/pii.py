"""Personal information inside free text: found, and replaced by typed placeholders.

Bootstrapped contextual extraction. Seed entities start the search: plain mail addresses, phone numbers with a country code,
identity numbers whose check digit holds, addresses in full, and names after seed contexts. Whatever else has a loose shape
of its kind is a candidate. Candidates and seeds are instances, linked to lexical patterns: how they are written (form), the
words before and after them, the ending of a mail host. Spark counts that graph over the whole corpus and scores both sides
in turn: a pattern by the share of its distinct instances that are believed, an instance by the patterns that hold it, with
seeds believed and impossible numbers disbelieved throughout. High-confidence patterns admit the candidates that no seed
covers, contexts that mostly hold other numbers (orders, parcels, groups) refuse them. Without a learned model only seeds
are found.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadquarry.runtime import Scratch, spread

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "identity": "[IDENTITY]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Rounds of scoring, and the least scores of patterns that find names and of contexts that let a number pass.
ROUNDS = 3
PATTERN_SCORE = 0.4
CONTEXT_SCORE = 0.35
#: Least scores of forms and of contexts that admit candidates of their kind, and rounds of that graph.
FORM_SCORE, ADMIT_SCORE = 0.5, 0.6
FORM_ROUNDS = 4
#: Rows of the learned model up to which each task receives all of it; a larger one is joined with what each text looks up.
MODEL_ROWS = 200_000
#: The parts of the model that grow with the corpus. Family names of one character and English lead words have an end.
PARTS = ("patterns", "given", "refused", "left", "right", "sure", "common", "en_given", "en_family", "en_left", "en_right", "en_sure", "typed")
_SCORED = ("left", "right", "en_left", "en_right")
#: Characters of a context inside longer text, before and after a name.
BEFORE, AFTER = 4, 2
#: Pairs a task collects before it passes them on.
COLLECT_PAIRS = 30_000

#: Contexts that start the search for names (text before, text after).
SEED_PATTERNS = (("我叫", ""), ("收件人", ""), ("联系人", ""), ("户名", ""), ("本人姓名", ""), ("my name is", ""), ("contact person", ""))
#: Family names that start the search, two-character ones first.
FAMILIES_2 = frozenset("欧阳 司马 上官 诸葛 司徒 东方 独孤 南宫 万俟 闻人 夏侯 皇甫 尉迟 公羊 澹台 公冶 宗政 濮阳 淳于 单于 太叔 申屠 公孙 仲孙 轩辕 令狐 钟离 宇文 长孙 慕容 鲜于 司空 端木 百里 呼延 西门 东郭 南门".split())
FAMILIES_1 = frozenset(
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦许何吕张孔曹华金魏陶姜戚谢邹喻柏窦章苏潘葛范彭郎鲁韦昌马苗方俞任袁柳鲍史唐费廉岑薛"
    "雷贺倪汤滕殷罗毕郝邬安常乐于傅卞齐康伍余元顾孟黄穆萧尹姚邵汪祁毛禹狄米贝戴宋庞熊纪舒屈项祝董梁杜阮蓝闵季麻贾江童颜郭梅林刁钟徐邱骆高夏蔡田胡凌霍"
    "芮佘缪郗逄麦晏闻蔺殳亓"
)
#: Titles that follow a family name without making it a person's full name.
TITLES = ("老师", "师傅", "先生", "女士", "小姐", "太太", "经理", "医生", "同学", "店长", "主任", "老板", "阿姨", "叔叔", "总", "哥", "姐", "姨", "叔", "导", "工", "某", "某某", "氏", "家", "家人")
_DIGITS = {c: str(i) for i, c in enumerate("零一二三四五六七八九")} | {"〇": "0", "幺": "1", "两": "2"}


def _width_table() -> dict[int, int]:
    table = {0x3000: 0x20}
    for c in range(0xFF01, 0xFF5F):
        table[c] = c - 0xFEE0
    return table


_WIDTH = _width_table()
_COMMON_WIDE = [(chr(c), chr(_WIDTH[c])) for c in map(ord, "，！？：；（）～")]
_ANY_WIDE = re.compile("[\u3000\uff01-\uff5e]")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿]")


def normalize(text: str) -> tuple[str, list[int] | None]:
    """Halfwidth text without invisible characters, and where each of its characters stands in ``text`` (None: unchanged)."""
    if text.isascii():
        return text, None
    wide = text
    for a, b in _COMMON_WIDE:  # most wide characters are these, and single replacements are faster than a table
        wide = wide.replace(a, b)
    if _ANY_WIDE.search(wide):
        wide = wide.translate(_WIDTH)
    if not _INVISIBLE.search(wide):
        return wide, None
    at = [i for i, c in enumerate(wide) if not _INVISIBLE.match(c)]
    return "".join(wide[i] for i in at), at


_SEP = r"[\s.\-_–—·]{0,3}"
_L, _R = r"(?<![\dA-Za-z*•＊])", r"(?![\d*•＊])"
_NUMBER = re.compile(r"[+(]{0,2}\d[\d\s().\-_–—·+]{5,26}[\dXx]")
_ZH_NUMBER = re.compile(r"[零〇一二三四五六七八九幺](?:[\s.\-]?[零〇一二三四五六七八九幺两]){6,20}")
_PHONES = [
    re.compile(r"(?<![\d*•])(?:\(?(?:\+|00)\s?86\)?[\s\-]*|\(?86\)[\s\-]*)?1[3-9]\d" + _SEP + r"\d{4}" + _SEP + r"\d{4}" + _R),
    re.compile(r"(?<![\d*•])(?:\(?\+?86\)?[\s\-]*)?\(?0\d{2,3}\)?[\s\-–—]{0,3}[1-9]\d{6,7}" + _R),
    re.compile(r"(?<![\d*•])(?:\(?\+?1\)?[\s.\-]{0,2})?\(?[2-9]\d{2}\)?[\s.\-]{1,2}\d{3}[\s.\-]{1,2}\d{4}" + _R),
    re.compile(r"(?<![\d*•])\+\d{1,3}[\s\-]?\(?\d{2,4}\)?(?:[\s\-]?\d{2,4}){2,4}" + _R),
]
_ID18 = re.compile(r"(?<![\d*•])([1-9]\d{5})" + _SEP + r"((?:19|20)\d{2})[\s.\-]?(\d{2})[\s.\-]?(\d{2})" + _SEP + r"\d{3}[\dXx](?![\dA-Za-z*•])")
_ID15 = re.compile(r"(?<![\d*•])([1-9]\d{5})" + _SEP + r"(\d{2})(\d{2})(\d{2})" + _SEP + r"\d{3}" + r"(?![\dA-Za-z*•])")
_LOCAL = r"(?<![A-Za-z0-9._+\-*•])[A-Za-z0-9](?:[A-Za-z0-9._+\-]{0,62}[A-Za-z0-9_+])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]{0,40}[A-Za-z0-9])?"
_AT = r"(?:\s*(?:@|[(\[{<]\s*at\s*[)\]}>])\s*|\s+at\s+)"
_DOT = r"(?:\s*(?:[(\[{<]\s*dot\s*[)\]}>])\s*|\s+dot\s+)"
_EMAILS = [
    re.compile(_LOCAL + r"(?:\s{0,3}@\s{0,3}|\s{0,2}[(\[{<]\s?at\s?[)\]}>]\s{0,2})" + _LABEL + r"(?:\." + _LABEL + r")*\.[A-Za-z]{2,24}(?![A-Za-z0-9])", re.I),
    re.compile(_LOCAL + _AT + _LABEL + "(?:(?:" + _DOT + r"|\.)" + _LABEL + ")*" + _DOT + r"[A-Za-z]{2,24}(?![A-Za-z0-9])", re.I),
    # Glued spellings: whatever is not a letter around "at" and "dot" may be missing. They need an ending that mail hosts have.
    re.compile(_LOCAL + _AT + r"[A-Za-z0-9\-]{1,40}?(?:dot[A-Za-z0-9\-]{2,30}?){0,3}dot[A-Za-z]{2,12}(?![A-Za-z0-9])", re.I),
    re.compile(r"(?<![A-Za-z0-9._+\-*•])[A-Za-z0-9][A-Za-z0-9._+\-]{1,60}?at[A-Za-z0-9\-]{1,40}?(?:(?:" + _DOT + r"|dot|\.)[A-Za-z0-9\-]{2,30}?){0,3}(?:" + _DOT + r"|dot)[A-Za-z]{2,12}(?![A-Za-z0-9])", re.I),
]
_H = "一-鿿㐀-䶿"
_HOUSE = r"(?:第\s?)?(?:\d{1,5}|[零〇一二三四五六七八九十百千两]{1,7})(?:\s?[-–—之/]\s?\d{1,4})?\s?(?:弄|号)(?!线|发货|方案|公交|字|店铺?号)"
_ADDRESSES = [
    re.compile(
        rf"(?:[{_H}]{{2,6}}(?:省|自治区)[\s,]{{0,3}})?(?:[{_H}]{{2,5}}?(?:市|州)[\s,]{{0,3}})?(?:[{_H}]{{1,5}}?(?:区|县|镇|乡|旗)[\s,]{{0,3}})?"
        rf"[{_H}]{{1,7}}?(?:大街|大道|胡同|路|街|巷|道|里弄)\s{{0,3}}{_HOUSE}"
        r"(?:\s?\d{1,4}\s?(?:号楼|号|幢|栋|座|单元|层|楼|室|弄))*(?:\s?\d{1,4}(?![\d年月日:.\-]))?"
    ),
    re.compile(r"(?<![\d.])\d{1,5}[A-Za-z]?\s+(?:(?:[A-Z][A-Za-z']+|[NSEW]\.?)\s+){1,4}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way|Place|Pl|Terrace|Square|Close|Crescent)\b\.?(?:,?\s*(?:Apt|Unit|Suite|#)\.?\s*\w{1,6})?"),
    re.compile(r"(?<![\d.])\d{1,5}\s+(?:[a-z']{2,}\s+){1,3}(?:street|road|avenue|ave|lane|drive|boulevard|blvd|rd|dr)\b\.?(?:,?\s*(?:apt|unit|suite)\.?\s*\w{1,6})?(?!\s+(?:to|for|map|and|through))", re.I),
]
#: What stands before an address without being part of it.
_LEAD_IN = re.compile("^.{0,3}?(?:住在|寄到|寄往|收货|就在|店在|家在|送到|发到|位于|搬到|来到|地址)(?=..)")
#: Cheap looks that decide whether the shapes are tried at all; each holds wherever its shapes can match.
_SEVEN_DIGITS = re.compile(r"\d(?:[^\dA-Za-z]{0,4}\d){6}")
_AT_LOOK = re.compile(r"at\s?[)\]}>]", re.I)
_HOUSE_LOOK = re.compile(r"\d[A-Za-z]?\s")
_STREET_LOOK = re.compile(r"\b(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|boulevard|blvd|court|ct|way|place|pl|terrace|square|close|crescent)\b", re.I)
_STREET_HINT = re.compile("[路街巷道弄同]")


def _valid_date(y: str, m: str, d: str) -> bool:
    return 1 <= int(m) <= 12 and 1 <= int(d) <= 31 and (len(y) == 2 or 1900 <= int(y) <= 2030)


def _context(t: str, start: int) -> str:
    """The letters just before a number, up to four, without separators: the left side of its pattern."""
    left = re.sub(r"[^A-Za-z一-鿿]+", "", t[max(0, start - 8) : start]).lower()
    return left[-4:] if left.isascii() else left[-2:]


def numbers(t: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, strong) of number shapes; strong ones have structure beyond their digits."""
    out: list[tuple[str, int, int, bool]] = []
    taken: list[tuple[int, int]] = []

    def put(kind: str, a: int, b: int, strong: bool) -> None:
        if not any(x < b and a < y for x, y in taken):
            taken.append((a, b))
            out.append((kind, a, b, strong))

    for m in _ID18.finditer(t):
        if _valid_date(m[2], m[3], m[4]):
            put("identity", m.start(), m.end(), True)
    for m in _ID15.finditer(t):
        if _valid_date(m[2], m[3], m[4]):
            put("identity", m.start(), m.end(), False)
    for i, p in enumerate(_PHONES):
        for m in p.finditer(t):
            strong = bool(re.search(r"[^\d]", m[0])) or i == 3
            put("phone", m.start(), m.end(), strong)
    return out


def zh_phones(t: str) -> list[tuple[str, int, int, bool]]:
    out = []
    for m in _ZH_NUMBER.finditer(t):
        d = "".join(_DIGITS.get(c, "") for c in m[0])
        if re.fullmatch(r"1[3-9]\d{9}|0\d{2,3}[1-9]\d{6,7}", d):
            out.append(("phone", m.start(), m.end(), True))
        elif re.fullmatch(r"[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{4}", d):
            out.append(("identity", m.start(), m.end(), True))
    return out


# ---------------------------------------------------------------- candidates

_CHECK = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)  # fixed value: weights of an identity number's check digit
_ABROAD = re.compile(r"[(\s]*(?:\+|00\s?86)")
_AT_WORD = re.compile(r"[(\[{<]\s*at\s*[)\]}>]|\sat\s|@")
_DOT_WORD = re.compile("dot")
#: What candidates are written like, by kind. A fixed few, so that each is scored by many instances.
FORMS = {
    "email": ("plain", "spaced", "bracketed", "worded", "glued"), "phone": ("abroad", "mobile", "mobile_cut", "other", "other_cut", "han"),
    "identity": ("checked", "new", "new_cut", "old", "old_cut", "han"), "address": ("full", "zh", "zh_han", "en", "en_other"),
}
SEED_FORMS = {("email", "plain"), ("phone", "abroad"), ("identity", "checked"), ("address", "full"), ("address", "en")}


def checked(number: str) -> bool:
    """Whether the last digit of an 18-digit identity number is its check digit."""
    return len(number) == 18 and number[:17].isdigit() and "10X98765432"[sum(int(d) * w for d, w in zip(number, _CHECK)) % 11] == number[17]


def _mail_form(i: int, s: str) -> str:
    return "glued" if i > 1 else "bracketed" if re.search(r"[(\[{<]\s*(?:at|dot)", s, re.I) else "worded" if i else "spaced" if re.search(r"\s", s) else "plain"


def _number_form(kind: str, s: str) -> tuple[str, str]:
    """Form and digits of a number."""
    digits = re.sub(r"[^\dXx]", "", s).upper()
    cut = "_cut" if re.search(r"\d[^\dXx]+[\dXx]", s) else ""
    if kind == "identity":
        return ("checked" if checked(digits) else ("new" if len(digits) == 18 else "old") + cut), digits
    if _ABROAD.match(s):
        return "abroad", re.sub("^(?:00)?86(?=1)", "", digits)
    return ("mobile" if len(digits) == 11 and digits[0] == "1" else "other") + cut, digits


def candidates(t: str) -> Iterator[tuple[str, int, int, str, str, bool, str]]:
    """(kind, start, end, form, instance, weak, ending) of whatever has a loose shape of its kind in a normalised text, those
    that take precedence first. Weak ones are digits without structure; the ending is a mail host's."""
    low = t.lower()
    if "@" in t or "dot" in low or _AT_LOOK.search(t):
        for i, p in enumerate(_EMAILS):
            for m in p.finditer(t):
                x = m[0].lower()
                end = re.search("[a-z]+$", x)[0] if i < 2 else x[x.rindex("dot") + 3:].strip(" )]}>")
                yield "email", m.start(), m.end(), _mail_form(i, m[0]), re.sub("[^a-z0-9]", "", _DOT_WORD.sub("", _AT_WORD.sub("", x))), False, end
    if _SEVEN_DIGITS.search(t):
        for kind, a, b, strong in numbers(t):
            yield kind, a, b, *_number_form(kind, t[a:b]), not strong, ""
    # The first number and any street word after it, each looked for once: a text takes linear time.
    house = _HOUSE_LOOK.search(t)
    if house and _STREET_LOOK.search(t, house.end()):
        for i, p in enumerate(_ADDRESSES[1:]):
            for m in p.finditer(t):
                yield "address", m.start(), m.end(), "en_other" if i or not _EN_FULL.search(m[0]) else "en", re.sub("[^a-z0-9]", "", m[0].lower()), False, ""
    if not t.isascii():
        for kind, a, b, _ in zh_phones(t):
            yield kind, a, b, "han", "".join(_DIGITS.get(c, "") for c in t[a:b]), False, ""
        if _STREET_HINT.search(t) and ("号" in t or "弄" in t):
            for m in _ADDRESSES[0].finditer(t):
                lead = _LEAD_IN.match(m[0])
                a = m.start() + (lead.end() if lead else 0)
                x = re.sub(r"[\s,]", "", t[a : m.end()])
                yield "address", a, m.end(), "full" if _ZH_FULL.match(x) else "zh" if re.search(r"\d", x) else "zh_han", x, False, ""


_EN_FULL = re.compile(r"\b(?:Street|Road|Avenue|Lane|Drive)\b")
_ZH_FULL = re.compile(rf"[{_H}]{{2,}}[省市州区县].*\d")


def _after(t: str, end: int) -> str:
    """The letters just after a candidate: the right side of its pattern."""
    right = re.sub(r"[^A-Za-z一-鿿]+", "", t[end : end + 8]).lower()
    return right[:4] if right.isascii() else right[:2]


def _typed_keys(kind: str, t: str, a: int, b: int) -> list[str]:
    """The contexts of a candidate as keys of the model."""
    return [f"{kind}|{side}|{c}" for side, c in (("l", _context(t, a)), ("r", _after(t, b))) if c]


# ---------------------------------------------------------------- names

_CLAUSE = re.compile(r"[，。；！？、,;!?…~\n\r\t\"“”「」【】\[\]<>|]+|\.(?=\s|$|[^\x00-\x7f])|\.{2,}")
_BARE = re.compile(rf"[^{_H}]+")
_HAN = re.compile(rf"[{_H}]+")
_LATIN = re.compile("[A-Za-z0-9]")


def family_of(s: str, learned: frozenset[str] = frozenset()) -> str | None:
    if s[:2] in FAMILIES_2:
        return s[:2] if 3 <= len(s) <= 4 else None
    if (s[:1] in FAMILIES_1 or s[:1] in learned) and 2 <= len(s) <= 3:
        return s[:1]
    return None


def is_full_name(s: str, learned: frozenset[str] = frozenset()) -> bool:
    f = family_of(s, learned)
    return bool(f) and s[len(f):] not in TITLES


def clauses(t: str) -> Iterator[tuple[str, int, int]]:
    """Stretches of Han characters between separators, also over one or two spaces or colons: (letters, start, end)."""
    at = 0
    for m in [*_CLAUSE.finditer(t), None]:
        end = m.start() if m else len(t)
        words = [(x.group(0), x.start(), x.end()) for x in _HAN.finditer(t, at, end)] if end - at >= 2 else []
        for i in range(len(words)):
            s = ""
            for j in range(i, min(i + 3, len(words))):
                if j > i and (words[j][1] - words[j - 1][2] > 3 or _LATIN.search(t, words[j - 1][2], words[j][1])):
                    break
                s += words[j][0]
                if len(s) >= 2:
                    yield s, words[i][1], words[j][2]
        at = m.end() if m else end


def splits(s: str) -> Iterator[tuple[str, str, str]]:
    """(before, name, after) readings of a whole short clause; at least one side is text. Longer ones are for ``slides``."""
    n = len(s)
    for k in (2, 3, 4):
        for i in range(0, min(6, n - k) + 1):
            after = n - i - k
            if after <= 3 and (i or after):
                yield s[:i], s[i : i + k], s[i + k :]


def slides(s: str, learned: frozenset[str] = frozenset()) -> Iterator[tuple[int, list[str]]]:
    """Where in a stretch of any length a family name stands, and the full names it may begin there."""
    for i in range(len(s) - 1):
        if s[i] in FAMILIES_1 or s[i : i + 2] in FAMILIES_2 or s[i] in learned:
            names = [s[i : i + k] for k in (2, 3, 4) if i + k <= len(s) and is_full_name(s[i : i + k], learned)]
            if names:
                yield i, names


def _titled(s: str, at: int) -> bool:
    """Whether a title stands at ``at``; those of one character only where the stretch ends with them."""
    return any(s.startswith(x, at) and (len(x) > 1 or at + 1 == len(s)) for x in TITLES)


def _collect_pairs():
    """Batches of texts to counted (kind, before, after, instance, seed) pairs of patterns and instances."""

    def flush(seen: Counter) -> pa.RecordBatch:
        cols = list(zip(*[(*k, n) for k, n in seen.items()])) or [()] * 6
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in cols[:4]], pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.int64())], ["kind", "before", "after", "instance", "valid", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        stretches: Counter = Counter()

        def spread() -> None:
            for s, n in stretches.items():
                for before, inst, after in splits(s):
                    # Instances without a known family name are kept only beside the context, where they speak against it.
                    seen["zh", before, after, inst, is_full_name(inst)] += n
                for i, names in slides(s):
                    for k in range(1, min(BEFORE, i) + 1):
                        seen["open", s[i - k : i], "", s[i : i + 4], True] += n
                    if i == 0:
                        seen["open", "^", "", s[:4], True] += n
                    for x in names:
                        if after := s[i + len(x) : i + len(x) + AFTER]:
                            seen["open", "", after, x, True] += n
            stretches.clear()

        for b in batches:
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                t, _ = normalize(text)
                for s, _a, _b in clauses(t):
                    stretches[s] += 1
                for before, g, f in _en_candidates(t):
                    caps = g[0].isupper() and f[0].isupper() and g[1:].islower() and f[1:].islower()
                    seen["en", before, "", f"{g.lower()} {f.lower()}", caps] += 1
                for m in _EN_CAPS.finditer(t):
                    f = _bare(m[2])
                    before, after = _around(t, m.start(1), m.start(2) + len(f))
                    x = f"{m[1].lower()} {f.lower()}"
                    for c in before:
                        seen["eopen", c, "", x, True] += 1
                    for c in after:
                        seen["eopen", "", c, x, True] += 1
                for kind, a, z, form, x, _, ending in candidates(t):
                    inst, seed = f"{kind}:{x}", True if (kind, form) in SEED_FORMS else None
                    for key in (f"{kind}|form|{form}", *([f"{kind}|end|{ending}"] if ending else []), *_typed_keys(kind, t, a, z)):
                        seen["typed", key, "", inst, seed] += 1
                for m in _NUMBER.finditer(t):
                    d = re.sub(r"\D", "", m[0])
                    if len(d) in (11, 15, 17, 18) and m[0].isdigit() and (c := _context(t, m.start())):
                        ok = bool(re.fullmatch(r"1[3-9]\d{9}", d)) if len(d) == 11 else any(k == "identity" for k, *_ in numbers(m[0]))
                        # Digits alone: what can be no number of its kind is disbelieved, and speaks against its context.
                        kind = "phone" if len(d) == 11 else "identity"
                        for key in (f"number|l|{c}", f"{kind}|l|{c}"):
                            seen["typed", key, "", f"{kind}:{d}", None if ok else False] += 1
            if len(stretches) + len(seen) >= COLLECT_PAIRS:
                spread()
                yield flush(seen)
                seen = Counter()
        spread()
        yield flush(seen)

    return run


#: Words that may lead to a name in English and start the search; which of them do, and what else does, is learned.
_EN_WORDS = tuple("ask for|my name is|contact person|this is|call me|attn|regards|signed|name is|speak to|talk to|email to|dear|sincerely|thanks to|i am|i'm|it's|from|by|with|to|for|and|is".split("|"))


def _leads(words) -> re.Pattern[str]:
    return re.compile(r"\b(" + "|".join(map(re.escape, words)).replace(r"\ ", r"\s") + r")\s*[:,]?\s+([A-Za-z][a-zA-Z'\-]{1,20})\s+([A-Za-z][a-zA-Z'\-]{1,24})", re.I)


_EN_LEADS = _leads(_EN_WORDS)
#: What may follow a name while contexts are learned; what is believed by then is found before any word.
_EN_END = re.compile(r"\s+(?:at|on|in|from|before|after|if|here|speaking|please)\b|\s*[^\sA-Za-z]|\s*$", re.I)


def _en_candidates(t: str) -> Iterator[tuple[str, str, str]]:
    for m in _EN_LEADS.finditer(t):
        if _EN_END.match(t, m.end()):
            yield " ".join(m[1].lower().split()), m[2], m[3]


_EN_PAIR = re.compile(r"(?<![A-Za-z'\-])([A-Za-z][A-Za-z'\-]{1,20})\s+(?=([A-Za-z][A-Za-z'\-]{1,24}))")
_EN_CAPS = re.compile(r"(?<![A-Za-z'\-])([A-Z][a-z'\-]{1,20})\s+(?=([A-Z][a-z'\-]{1,24})(?![A-Za-z]))")
_TOKEN = re.compile(r"[a-z']+|[^\sa-z]")


def _bare(family: str) -> str:
    """A family name without the mark of a possessive or a quotation."""
    return family.removesuffix("'s").rstrip("'-")


def _around(t: str, a: int, b: int) -> tuple[list[str], list[str]]:
    """Contexts in English of what stands from a to b: the one and two words or signs before it, and after it. One must be a word."""
    before, after = _TOKEN.findall(t[max(0, a - 40) : a].lower())[-2:], _TOKEN.findall(t[b : b + 40].lower())[:2]
    some = lambda xs: [x for x in dict.fromkeys(xs) if any("a" <= c <= "z" for c in x)]
    return some([" ".join(before[-k:]) for k in (1, 2)]), some([" ".join(after[:k]) for k in (1, 2)])


class Model:
    """What tasks need of the scored graph."""

    def __init__(self, patterns, families, given, en_patterns, en_given, en_family, refused, left=(), right=(), sure=(), common=(), en_left=(), en_right=(), en_sure=(), forms=(), typed=()):
        self.patterns = {(b, a): s for b, a, s in patterns}
        self.families = frozenset(families)
        self.given = frozenset(given)
        self.en_patterns = {b: s for b, s in en_patterns}
        self.leads = _leads(sorted(self.en_patterns, key=lambda b: (-len(b), b))) if self.en_patterns else None
        self.en_given, self.en_family = frozenset(en_given), frozenset(en_family)
        self.refused = frozenset(refused)
        self.left, self.right, self.sure, self.common = dict(left), dict(right), frozenset(sure), frozenset(common)
        self.en_left, self.en_right, self.en_sure = dict(en_left), dict(en_right), frozenset(en_sure)
        self.forms, self.typed = frozenset(forms), frozenset(typed)  # admitted (kind, form), and keys of contexts and endings
        # Each name begins with one of these.
        self.starts = re.compile("[" + "".join(sorted(FAMILIES_1 | self.families | {f[0] for f in FAMILIES_2})) + "]")
        self.read: dict[str, list[tuple[int, int]]] = {}

    def hold(self, entries) -> Model:
        """Replace the parts that grow by ``entries`` (part, key, score), all of them or those that a text looks up."""
        by: dict[str, dict[str, float]] = {p: {} for p in PARTS}
        for part, key, score in entries:
            by[part][key] = score
        self.patterns = {tuple(k.split("\x1f")): v for k, v in by.pop("patterns").items()}
        for part, held in by.items():
            setattr(self, part, held if part in _SCORED else frozenset(held))
        self.read = {}
        return self

    def lookups(self, t: str) -> set[tuple[str, str]]:
        """(part, key) of all that ``find`` may ask the model about a normalised text."""
        out = set()
        for kind, a, b, _, _, weak, ending in candidates(t):
            out |= {("typed", k) for k in _typed_keys(kind, t, a, b)} | ({("refused", _context(t, a))} if weak else set()) | ({("typed", f"{kind}|end|{ending}")} if ending else set())
        for s in {s for s, _, _ in clauses(t)} if self.starts.search(t) else ():
            for before, x, after in splits(s):
                if is_full_name(x, self.families):
                    out |= {("patterns", f"{before}\x1f{after}"), ("given", x[len(family_of(x, self.families)):])}
            for i, names in slides(s, self.families):
                out |= {("left", s[i - k : i]) for k in range(1, min(BEFORE, i) + 1)} | {("common", s[i : i + 2])}
                f = len(family_of(names[0], self.families))
                for x in names:
                    out |= {("sure", x), ("given", x[f:]), ("right", s[i + len(x) : i + len(x) + AFTER])}
        for m in self.leads.finditer(t) if self.leads else ():
            out |= {("en_given", m[2].lower()), ("en_family", m[3].lower())}
        for m in _EN_PAIR.finditer(t):
            g, f = m[1].lower(), _bare(m[2]).lower()
            before, after = _around(t, m.start(1), m.start(2) + len(f))
            out |= {("en_given", g), ("en_family", f), ("en_sure", f"{g} {f}")} | {("en_left", c) for c in before} | {("en_right", c) for c in after}
        return out

    def stretch(self, s: str) -> list[tuple[int, int]]:
        """(first character, length) of the names in a stretch. What was read is remembered, for speed only."""
        if s not in self.read:
            if len(self.read) >= COLLECT_PAIRS:
                self.read.clear()
            self.read[s] = sorted({*self.whole(s), *self.inside(s)}, key=lambda x: (-x[1], x[0]))  # of overlapping ones the longest holds
        return self.read[s]

    def whole(self, s: str) -> Iterator[tuple[int, int]]:
        best = None
        for before, inst, after in splits(s):
            score = self.patterns.get((before, after))
            if score is None or not is_full_name(inst, self.families):
                continue
            rest = inst[len(family_of(inst, self.families)):]
            # Of several readings the longest name holds: a given name's end is no context.
            if (score >= 0.75 or rest in self.given) and (best is None or len(inst) > best[1]):
                best = (len(before), len(inst))
        if best:
            yield best

    def inside(self, s: str) -> Iterator[tuple[int, int]]:
        """Names in text of any length: believed ones and those of known parts by themselves, others beside open contexts."""
        for i, names in slides(s, self.families):
            left = max([self.left.get(s[i - k : i], 0.0) for k in range(1, min(BEFORE, i) + 1)], default=0.0)
            f = len(family_of(names[0], self.families))
            titled = _titled(s, i + f)
            best = 0
            for x in names:
                end = i + len(x)
                right = self.right.get(s[end : end + AFTER], 0.0) if end < len(s) else 0.0
                known = x[f:] in self.given or x in self.sure
                if known and (len(x) - f > 1 or left or right) or x in self.sure and len(x) == len(s):
                    best = len(x)
                elif not titled and not known and (left and right or left >= 0.75 and end == len(s) or i == 0 and right >= 0.75):
                    best = max(best, len(x))
            # After a strong context a name that nobody else bears has two characters, if what begins there isn't a common word.
            if not best and left >= 0.75 and not titled and s[i : i + 2] not in self.common:
                best = min(f + 2, len(names[-1]))
            if best:
                yield i, best

    def names(self, t: str) -> Iterator[tuple[str, int, int, bool]]:
        if self.starts.search(t):
            for s, a, b in clauses(t):
                for skip, length in self.stretch(s):
                    yield "name", *_han_span(t, a, b, skip, length), True
        for m in self.leads.finditer(t) if self.leads else ():
            before = " ".join(m[1].lower().split())
            if before in self.en_patterns:
                g, f = m[2], m[3]
                caps = g[0].isupper() and f[0].isupper() and g[1:].islower() and f[1:].islower()
                known = (g.lower() in self.en_given) + (f.lower() in self.en_family)
                if known == 2 or caps and _EN_END.match(t, m.end()) and (known or self.en_patterns[before] >= 0.5):
                    yield "name", m.start(2), m.end(3), True
        yield from self.en_names(t)

    def en_names(self, t: str) -> Iterator[tuple[str, int, int, bool]]:
        """Believed names and pairs of known parts anywhere, other capitalised pairs beside learned contexts."""
        if not (self.en_sure or self.en_given or self.en_left or self.en_right):
            return
        for m in _EN_PAIR.finditer(t):
            g, f = m[1], _bare(m[2])
            a, b = m.start(1), m.start(2) + len(f)
            low = (g.lower(), f.lower())
            known = (low[0] in self.en_given) + (low[1] in self.en_family)
            caps = g[0].isupper() and f[0].isupper()
            if known == 2 or caps and " ".join(low) in self.en_sure:
                yield "name", a, b, True
            elif caps and g[1:].islower() and f[1:].islower():
                before, after = _around(t, a, b)
                left = max([self.en_left.get(c, 0.0) for c in before], default=0.0)
                right = max([self.en_right.get(c, 0.0) for c in after], default=0.0)
                if known and (left or right) or left >= 0.5 and (right or _EN_END.match(t, b)):
                    yield "name", a, b, True

    def find(self, t: str) -> list[tuple[str, int, int]]:
        """Disjoint (kind, start, end) in a normalised text, by start."""
        got: list[tuple[str, int, int]] = []

        def put(kind: str, a: int, b: int) -> None:
            if not any(x < b and a < y for _, x, y in got):
                got.append((kind, a, b))

        for kind, a, b, form, _, weak, ending in candidates(t):
            if self.admits(kind, form, t, a, b, ending) and not (weak and _context(t, a) in self.refused):
                put(kind, a, b)
        for kind, a, b, _ in self.names(t):
            put(kind, a, b)
        return sorted(got, key=lambda x: x[1])

    def admits(self, kind: str, form: str, t: str, a: int, b: int, ending: str) -> bool:
        """Whether a candidate is a seed, or written or placed as believed instances of its kind are."""
        if (kind, form) in SEED_FORMS:
            return True
        if form == "glued" and f"{kind}|end|{ending}" not in self.typed:
            return False
        return (kind, form) in self.forms or any(k in self.typed for k in _typed_keys(kind, t, a, b))

    def redact(self, text: str) -> tuple[str, list[str]]:
        t, at = normalize(text)
        found = self.find(t)
        if not found:
            return text, []
        out, last = [], 0
        for kind, a, b in found:
            x, y = (a, b) if at is None else (at[a], at[b - 1] + 1)
            out += [text[last:x], PLACEHOLDERS[kind]]
            last = y
        return "".join(out) + text[last:], [k for k, _, _ in found]


def _han_span(t: str, a: int, b: int, skip: int, length: int) -> tuple[int, int]:
    """Where the ``length`` Han characters after the first ``skip`` stand between a and b."""
    at = [i for i in range(a, b) if not _BARE.match(t[i])]
    return at[skip], at[skip + length - 1] + 1


# ---------------------------------------------------------------- scoring in Spark


class SpreadModel:
    """A model too large for a task: ``base`` has what is bounded, ``entries`` (part, key, score) the rest."""

    def __init__(self, base: Model, entries: DataFrame):
        self.base, self.entries = base, entries


def _typed_patterns(pairs: DataFrame, scratch: Scratch) -> tuple[list[tuple[str, str]], DataFrame, DataFrame]:
    """Admitted forms, and keys of admitted contexts and endings and of refusing contexts (one column each)."""
    said = pairs.groupBy("instance").agg(F.max("valid").alias("seed"))  # a seed anywhere holds; what can be no number is one nowhere
    graph = scratch.keep(pairs.select(F.col("before").alias("pattern"), "instance").distinct().join(said, "instance"), "typed")
    belief = graph.select("instance", "seed").distinct().withColumn("belief", F.when(F.col("seed"), 1.0).otherwise(0.0))
    for r in range(FORM_ROUNDS + 1):
        scored = graph.join(belief.select("instance", "belief"), "instance").groupBy("pattern").agg(F.sum("belief").alias("mass"), F.count("*").alias("all"))
        scored = scratch.keep(scored.withColumn("score", F.col("mass") / (F.col("all") + 0.5)), f"typed{r}")
        if r < FORM_ROUNDS:
            # What refuses has no say in what is believed: number patterns repeat the contexts of both kinds.
            own = graph.where("pattern not like 'number|%'").join(scored.select("pattern", "score"), "pattern").groupBy("instance").agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.95)))))).alias("own"))
            scratch.drop(belief)
            belief = scratch.keep(own.select("instance", F.when(F.col("seed"), 1.0).when(~F.col("seed"), 0.0).otherwise(F.col("own")).alias("belief")), f"said{r}")
    kept = scored.where(f"pattern not like 'number|%' and score >= case when pattern like '%|form|%' then {FORM_SCORE} else {ADMIT_SCORE} end and all >= 2")
    forms = [tuple(r["pattern"].split("|form|")) for r in kept.where("pattern like '%|form|%'").collect()]  # at most those of FORMS
    refused = scored.where(f"pattern like 'number|l|%' and all >= 2 and mass < {CONTEXT_SCORE} * all").select(F.substring_index("pattern", "|", -1).alias("key"))
    return forms, kept.where("pattern not like '%|form|%'").select("pattern"), refused


def learn(texts: DataFrame, most_rows: int | None = None) -> Model | SpreadModel:
    """Score the graph of patterns and instances of a one-column text table, and keep all that is believed."""
    base, entries = learned(texts)
    if entries.count() > (MODEL_ROWS if most_rows is None else most_rows):
        return SpreadModel(base, entries)
    return base.hold(entries.collect())  # at most MODEL_ROWS rows


def learned(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The bounded part of the model, and all that grows with the corpus as (part, key, score)."""
    scratch = Scratch(texts.sparkSession, "pii")
    pairs = spread(texts).mapInArrow(_collect_pairs(), "kind string, before string, after string, instance string, valid boolean, n bigint")
    pairs = pairs.groupBy("kind", "before", "after", "instance").agg(F.max("valid").alias("valid"), F.sum("n").alias("n"))
    pairs = scratch.keep(pairs, "pairs")

    forms, typed, refused = _typed_patterns(pairs.where("kind = 'typed'"), scratch)

    seeds = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(a).alias("a")) for b, a in SEED_PATTERNS])
    names = pairs.where("kind in ('zh', 'en')")
    # Only contexts with some valid instance can become patterns; what else they hold counts against them.
    some = names.groupBy("kind", "before", "after").agg(F.count_if("valid").alias("good"), F.count("*").alias("all"), F.sum(F.when(F.col("valid"), F.col("n")).otherwise(0)).alias("obs"))
    some = some.withColumn("seed", F.array_contains(seeds, F.struct(F.col("before").alias("b"), F.col("after").alias("a")))).where(f"seed or good >= 2 and good >= {PATTERN_SCORE / 2} * all")
    some = scratch.keep(some, "contexts")
    graph = scratch.keep(names.where("valid").join(some.select("kind", "before", "after", "all", "seed"), ["kind", "before", "after"]).select("kind", "before", "after", "instance", "all", "seed"), "graph")
    # A family and a given name are instances too: belief flows through them to names seen only once.
    known = graph.select("kind", "instance", F.when(F.col("kind") == "en", F.substring_index("instance", " ", 1)).otherwise(F.expr("substring(instance, -2)")).alias("part")).distinct()
    known = scratch.keep(known, "parts")
    belief = graph.groupBy("kind", "instance").agg(F.when(F.max("seed"), 1.0).otherwise(0.0).alias("belief"))
    for r in range(ROUNDS):
        scored = graph.join(belief, ["kind", "instance"]).groupBy("kind", "before", "after").agg((F.sum("belief") / (F.max("all") + 0.5)).alias("score"), F.max("seed").alias("seed"), F.sum("belief").alias("mass"))
        scored = scratch.keep(scored.withColumn("score", F.when(F.col("seed"), F.greatest("score", F.lit(0.8))).otherwise(F.col("score"))), f"patterns{r}")
        named = graph.join(scored.select("kind", "before", "after", "score"), ["kind", "before", "after"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.95)))))).alias("own"))
        part = named.join(known, ["kind", "instance"]).groupBy("kind", "part").agg(F.count("*").alias("m"), F.avg("own").alias("shared")).where("m >= 2").drop("m")
        belief = scratch.keep(
            named.join(known, ["kind", "instance"]).join(part, ["kind", "part"], "left").select("kind", "instance", F.greatest(F.col("own"), F.coalesce("shared", F.lit(0.0)), F.lit(0.0)).alias("belief")), f"belief{r}")
    good = scored.where(f"seed or score >= {PATTERN_SCORE} and mass >= 1.2")
    good = scratch.keep(good, "good")
    en = good.where("kind = 'en'").collect()  # at most a row for each of _EN_WORDS
    believed = names.join(good.select("kind", "before", "after", "score"), ["kind", "before", "after"])
    given = believed.where("kind = 'zh' and valid").select("instance").distinct()
    given = given.withColumn("g", F.when(F.substring("instance", 1, 2).isin(*sorted(FAMILIES_2)), F.expr("substring(instance, 3)")).otherwise(F.expr("substring(instance, 2)")))
    given = scratch.keep(given.groupBy("g").agg(F.count("*").alias("m")).where("m >= 2"), "given")
    # A character is a family name if most of what follows it in name contexts are given names that others bear too.
    fresh = believed.where("kind = 'zh' and not valid and score >= 0.7").select(F.substring("instance", 1, 1).alias("c"), F.expr("substring(instance, 2)").alias("g")).distinct().join(given, "g", "left")
    families = fresh.groupBy("c").agg(F.count("m").alias("m"), F.count("*").alias("all")).where("m >= 3 and m >= 0.25 * all")
    sure = believed.where("kind = 'zh' and valid").select("instance", "score", F.when(F.substring("instance", 1, 2).isin(*sorted(FAMILIES_2)), F.expr("substring(instance, 3)")).otherwise(F.expr("substring(instance, 2)")).alias("g"))
    sure = scratch.keep(sure.join(given, "g", "left").where("score >= 0.75 or m is not null").select("instance").distinct().withColumn("hit", F.lit(True)), "sure")
    # Open contexts are scored by the believed names beside them; what else begins or ends like a name there speaks against them,
    # each once and as often as it stands there: a common word is one instance, however many texts hold it.
    share = F.least(F.count_if("hit") / F.count("*"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / F.sum("n"))
    windows = pairs.where("kind = 'open' and before <> ''").select("before", "instance", "n")
    starts = windows.select("before", "instance", "n", F.explode(F.array(*[F.substring("instance", 1, k) for k in (2, 3, 4)])).alias("p")).join(sure.withColumnRenamed("instance", "p"), "p", "left")
    starts = starts.groupBy("before", "instance").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("hit"), F.max("n").alias("n"))
    led = F.col("before").isin(*[b for b, _ in SEED_PATTERNS if b and not b.isascii()])
    keep = f"seed or good >= 2 and score >= {PATTERN_SCORE}"
    left = starts.where("before <> '^'").groupBy("before").agg(F.count_if("hit").alias("good"), share.alias("score")).withColumn("seed", led).where(keep)
    left = scratch.keep(left.select("before", F.when(F.col("seed"), F.greatest("score", F.lit(0.8))).otherwise(F.col("score")).alias("score")), "left")
    ends = pairs.where("kind = 'open' and before = ''").select("after", "instance", "n").join(sure, "instance", "left").groupBy("after").agg(F.count_if("hit").alias("good"), share.alias("score"))
    right = scratch.keep(ends.withColumn("seed", F.lit(False)).where(keep).select("after", "score"), "right")
    # Words that begin like a name after an open context, yet stand elsewhere more often.
    begin = F.substring("instance", 1, 2).alias("w")
    led = windows.join(left, "before", "left_semi").groupBy(begin, F.length("before").alias("l")).agg(F.sum("n").alias("n")).groupBy("w").agg(F.max("n").alias("led"))
    common = windows.where("length(before) = 1").groupBy(begin).agg(F.sum("n").alias("all")).join(led, "w").where("2 * led < all").select("w")
    words = believed.where("kind = 'en' and valid").select("instance").distinct().select(F.substring_index("instance", " ", 1).alias("g"), F.substring_index("instance", " ", -1).alias("f"))
    # English contexts are induced likewise: of the capitalised pairs beside them, enough must be believed.
    en_sure = scratch.keep(believed.where("kind = 'en' and valid and score >= 0.5").select("instance").distinct().withColumn("hit", F.lit(True)), "en_sure")
    beside = pairs.where("kind = 'eopen'").join(en_sure, "instance", "left")

    def induced(c: str) -> DataFrame:
        got = beside.where(F.col(c) != "").groupBy(c).agg(F.count_if("hit").alias("good"), share.alias("score"))
        return got.where(f"good >= 2 and score >= {PATTERN_SCORE}").select(c, "score")

    def shared(c: str) -> DataFrame:
        return words.groupBy(c).agg(F.count("*").alias("m")).where("m >= 2")

    parts = {
        "patterns": good.where("kind = 'zh'").select(F.concat_ws("\x1f", "before", "after"), "score"), "given": given.select("g"), "refused": refused, "typed": typed, "left": left, "right": right,
        "sure": sure.select("instance"), "common": common, "en_given": shared("g").select("g"), "en_family": shared("f").select("f"), "en_left": induced("before"), "en_right": induced("after"), "en_sure": en_sure.select("instance"),
    }
    entries = None
    for part, df in parts.items():
        rows = df.select(F.lit(part).alias("part"), F.col(df.columns[0]).alias("key"), (F.col("score") if "score" in df.columns else F.lit(1.0)).alias("score"))
        entries = rows if entries is None else entries.unionByName(rows)
    entries = scratch.keep(entries, "entries")
    # Family names are single characters, of which there are few.
    base = Model([], [r["c"] for r in families.collect()], [], [(r["before"], r["score"]) for r in en], [], [], [], forms=forms)
    return base, entries


def _with_entries(texts: DataFrame, model: Model | SpreadModel) -> tuple[DataFrame, Model]:
    """The texts over all cores, each with the entries that it looks up where the model is too large for a task."""
    texts = texts.select("field", "row_key", "text")
    if isinstance(model, Model):
        return spread(texts), model
    base = model.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(t, *x) for t in b.column(0).to_pylist() for x in sorted(base.lookups(normalize(t)[0]))]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["text", "part", "key"])

    asked = spread(texts.where("text <> ''").select("text").distinct()).mapInArrow(run, "text string, part string, key string")
    held = asked.join(model.entries, ["part", "key"]).groupBy("text").agg(F.collect_list(F.struct("part", "key", "score")).alias("entries"))  # bounded by the text
    return texts.join(held, "text", "left").select("field", "row_key", "text", "entries"), base


def _models(b: pa.RecordBatch, model: Model) -> Iterator[Model]:
    """The model of each row of a batch."""
    if "entries" not in b.schema.names:
        yield from (model for _ in range(b.num_rows))
        return
    for e in b.column("entries").to_pylist():
        yield model.hold((x["part"], x["key"], x["score"]) for x in e or ())


def redact(texts: DataFrame, model: Model | SpreadModel) -> DataFrame:
    """(field, row_key, text) to (field, row_key, text, redacted, kinds array<string>). A null text stays null with no kinds;
    empty texts stay empty; all characters outside of what is replaced stay as they are."""

    texts, model = _with_entries(texts, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [m.redact(t) if t else (t, []) for t, m in zip(b.column("text").to_pylist(), _models(b, model))]
            yield pa.RecordBatch.from_arrays(
                [b.column("field"), b.column("row_key"), b.column("text"), pa.array([x[0] for x in done], pa.string()), pa.array([sorted(set(x[1])) for x in done], pa.list_(pa.string()))],
                ["field", "row_key", "text", "redacted", "kinds"],
            )

    return texts.mapInArrow(run, "field string, row_key bigint, text string, redacted string, kinds array<string>")


def find(texts: DataFrame, model: Model | SpreadModel) -> DataFrame:
    """(field, row_key, text) to one (field, row_key, kind) row per row and kind present."""

    texts, model = _with_entries(texts, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, k, kind) for f, k, t, m in zip(*[b.column(c).to_pylist() for c in ("field", "row_key", "text")], _models(b, model)) if t for kind in sorted({x[0] for x in m.find(normalize(t)[0])})]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["field", "row_key", "kind"])

    return texts.mapInArrow(run, "field string, row_key bigint, kind string")
