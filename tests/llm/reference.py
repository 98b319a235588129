"""Brute-force versions of the corpus operators, on lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter

SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split((text or "").encode()) if w]


def exact(docs):
    key = lambda t: SPACE.sub(b" ", (t or "").encode())
    first, size = {}, Counter()
    for i, t in sorted(docs):
        first.setdefault(key(t), i)
        size[key(t)] += 1
    return {i: (first[key(t)], size[key(t)], first[key(t)] == i, hashlib.sha256(key(t)).hexdigest()) for i, t in docs}


def shingles(text, k):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def linked(docs, k=4, percent=85):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in sets}


def secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [x[2] for x in sorted(out)]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def private(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, f"email:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, f"ip:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, f"phone:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    again = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


def word_repeats(docs, n=13):
    first = {}
    for i, t in sorted(docs):
        w = words(t)
        for j in range(len(w) - n + 1):
            first.setdefault(tuple(w[j : j + n]), i)
    out = {}
    for i, t in docs:
        w = words(t)
        gone = {j + d for j in range(len(w) - n + 1) if first[tuple(w[j : j + n])] < i for d in range(n)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def byte_repeats(docs, n=100):
    first = {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        for j in range(len(b) - n + 1):
            first.setdefault(b[j : j + n], (i, j))
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if first[b[j : j + n]] != (i, j):
                gone[j : j + n] = b"\1" * n
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def cleaned(text, phrases):
    """The text without lines that are navigation, furniture, symbols or long without an end; None if more than half of its words go."""
    kept, lost = [], 0
    for line in (text or "").split("\n"):
        w = re.findall(r"[^\x20\x09-\x0D]+", line)
        bars = sum(x in ("|", ">", "»", "›", "·", "•") for x in w)
        furniture = len(w) <= 40 and any(p in line.lower() for p in phrases)
        symbols = 5 * len(re.findall(r"[#*$%&|<>]", line)) > len(line.encode())
        endless = len(w) >= 30 and not re.search("[.!?;:…。؟！？]", line)
        if w and (bars >= max(2, len(w) // 5) or furniture or symbols or endless):
            lost += len(w)
        else:
            kept.append(line)
    n, *_, failed = quality(text)
    return None if failed or 2 * lost > n else "\n".join(kept)


def iban_ok(text):
    s = re.sub("[ -]", "", text).upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def redacted(text):
    """Base kinds and addresses by regular expressions, account numbers by trying every end behind each cue."""
    kinds = ["email", "ip", "card", "phone", "url", "account"]
    spans = [(int(a), kinds.index(k), int(b)) for k, a, b in (x.split(":") for x in private(text))]
    spans += [(m.start(), 4, m.end()) for m in re.finditer(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/@:]+(?::[^\s/@]*)?@[A-Za-z0-9.-]+", text)]
    for m in re.finditer(r"(?i)(iban|account|acct|passport|ssn|social security|tax id)(?: ?(?:number|no\.?|id|#))?[\"']? ?[:=#]? ?[\"']?(?=[A-Z]{0,2}[0-9])", text):
        least, most = {"iban": (15, 34), "passport": (6, 9), "ssn": (9, 9), "social security": (9, 9), "tax id": (8, 13)}.get(m[1].lower(), (6, 18))
        for end in range(min(m.end() + 60, len(text)), m.end(), -1):
            found = text[m.end() : end]
            whole = re.fullmatch("[A-Za-z0-9]+(?:[ -][A-Za-z0-9]+)*", found) and not text[end : end + 1].isalnum()
            if m[1].lower() == "iban":
                good = whole and re.match("[A-Za-z]{2}[0-9]{2}", found) and iban_ok(found)
            else:
                good = whole and " " not in found and least <= sum(c.isdigit() for c in found) <= most
            if good:
                spans.append((m.end(), 5, end))
                break
    out, done = [], 0
    for a, k, b in sorted(spans):
        if a >= done:
            out += [text[done:a], f"[{kinds[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])
