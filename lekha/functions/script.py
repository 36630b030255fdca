"""Fixed values of the Bengali script and of the legacy glyph encoding."""

from __future__ import annotations

BANGLA = "\u0980-\u09ff"
DANDAS = "\u0964\u0965"
HALANT, RA, NUKTA = "\u09cd", "\u09b0", "\u09bc"
PRE_KAR = "\u09bf\u09c7\u09c8"
#: Consonants and the signs that close a cluster like one.
CONSONANTS = "\u0995-\u09a8\u09aa-\u09b0\u09b2\u09b6-\u09b9\u09df\u0981-\u0983\u09ce"
ZWNJ, ZWJ = "\u200c", "\u200d"
#: A code point that no text holds.
GUARD = "\ufdd0"

# Letters of the legacy encoding, which numbers them in the order of the alphabet.
_FROM_0X41 = "অইঈউঊঋএঐওঔকখগঘঙচছজঝঞটঠডঢণত"
_FROM_0X5F = "থদধনপফবভমযরলশষসহড়ঢ়য়ৎংঃঁ"
_ZERO = "\u09e6"

# Sequences of two and more code points, in the order in which they are replaced.
SEQUENCES = [
    ("্র্য", "ª¨"), ("র\u200c্য", "i¨"), ("ক্ক", "°"), ("ক্ট", "±"), ("ক্ত", "³"), ("ক্ব", "K¡"), ("স্ক্র", "¯Œ"),
    ("ক্র", "µ"), ("ক্ল", "K¬"), ("ক্ষ", "¶"), ("ক্স", "·"), ("গু", "¸"), ("গ্ধ", "»"), ("গ্ন", "Mœ"), ("গ্ম", "M¥"),
    ("গ্ল", "M\u00ad"), ("গ্রু", "Mªy"), ("ঙ্ক", "¼"), ("ঙ্ক্ষ", "•¶"), ("ঙ্খ", "•L"), ("ঙ্গ", "½"), ("ঙ্ঘ", "•N"),
    ("চ্চ", "”P"), ("চ্ছ", "”Q"), ("চ্ছ্ব", "”Q¡"), ("চ্ঞ", "”T"), ("জ্জ্ব", "¾¡"), ("জ্জ", "¾"), ("জ্ঝ", "À"),
    ("জ্ঞ", "Á"), ("জ্ব", "R¡"), ("ঞ্চ", "Â"), ("ঞ্ছ", "Ã"), ("ঞ্জ", "Ä"), ("ঞ্ঝ", "Å"), ("ট্ট", "Æ"), ("ট্ব", "U¡"),
    ("ট্ম", "U¥"), ("ড্ড", "Ç"), ("ণ্ট", "È"), ("ণ্ঠ", "É"), ("ন্স", "Ý"), ("ণ্ড", "Ð"), ("ন্তু", "š‘"), ("ণ্ব", "Y^"),
    ("ত্ত", "Ë"), ("ত্ত্ব", "Ë¡"), ("ত্থ", "Ì"), ("ত্ন", "Zœ"), ("ত্ম", "Z¥"), ("ন্ত্ব", "š—¡"), ("ত্ব", "Z¡"),
    ("থ্ব", "_¡"), ("দ্গ", "˜M"), ("দ্ঘ", "˜N"), ("দ্দ", "Ï"), ("দ্ধ", "×"), ("দ্ব", "Ø"), ("দ্ভ", "™¢"), ("দ্ম", "Ù"),
    ("দ্রু", "`ªæ"), ("ধ্ব", "aŸ"), ("ধ্ম", "a¥"), ("ন্ট", "›U"), ("ন্ঠ", "Ú"), ("ন্ড", "Û"), ("ন্ত্র", "š¿"),
    ("ন্ত", "šÍ"), ("স্ত্র", "¯¿"), ("ত্র", "Î"), ("ন্থ", "š’"), ("ন্দ", "›`"), ("ন্দ্ব", "›Ø"), ("ন্ধ", "Ü"),
    ("ন্ন", "bœ"), ("ন্ব", "š^"), ("ন্ম", "b¥"), ("প্ট", "Þ"), ("প্ত", "ß"), ("প্ন", "cœ"), ("প্প", "à"), ("প্ল", "cø"),
    ("প্স", "á"), ("ফ্ল", "d¬"), ("ব্জ", "â"), ("ব্দ", "ã"), ("ব্ধ", "ä"), ("ব্ব", "eŸ"), ("ব্ল", "eø"), ("ভ্র", "å"),
    ("ম্ন", "gœ"), ("ম্প", "¤ú"), ("ম্ফ", "ç"), ("ম্ব", "¤^"), ("ম্ভ", "¤¢"), ("ম্ভ্র", "¤£"), ("ম্ম", "¤§"),
    ("ম্ল", "¤\u00ad"), ("রু", "iæ"), ("রূ", "iƒ"), ("ল্ক", "é"), ("ল্গ", "ê"), ("ল্প", "í"), ("ল্ট", "ë"),
    ("ল্ড", "ì"), ("ল্ফ", "î"), ("ল্ব", "j¦"), ("ল্ম", "j¥"), ("ল্ল", "jø"), ("শু", "ï"), ("শ্চ", "ð"), ("শ্ন", "kœ"),
    ("শ্ব", "k¦"), ("শ্ম", "k¥"), ("শ্ল", "kø"), ("ষ্ক", "®‹"), ("ষ্ক্র", "®Œ"), ("ষ্ট", "ó"), ("ষ্ঠ", "ô"),
    ("ষ্ণ", "ò"), ("ষ্প", "®ú"), ("ষ্ফ", "õ"), ("ষ্ম", "®§"), ("স্ক", "¯‹"), ("স্ট", "÷"), ("স্খ", "ö"), ("স্ত", "¯Í"),
    ("স্তু", "¯‘"), ("স্থ", "¯’"), ("স্ন", "mœ"), ("স্প", "¯ú"), ("স্ফ", "ù"), ("স্ব", "¯^"), ("স্ম", "¯§"),
    ("স্ল", "¯\u00ad"), ("হু", "û"), ("হ্ণ", "nè"), ("হ্ন", "ý"), ("হ্ম", "þ"), ("হ্ল", "n¬"), ("হৃ", "ü"), ("র্", "©"),
    ("্র", "ª"), ("্য", "¨"),
]

# Marks that are replaced before all else.
MARKS = {"।": "|", "‘": "Ô", "’": "Õ", "“": "Ò", "”": "Ó"}

# Single code points outside the alphabet.
_SIGNS = {"্": "&", "আ": "Av", "া": "v", "ি": "w", "ী": "x", "ু": "y", "ূ": "~", "ৃ": "…", "ে": "‡", "ৈ": "‰", "ৗ": "Š", "৳": "$"}


def letters() -> dict[str, str]:
    """Single code points and what each becomes; applied after all sequences."""
    out = {c: chr(0x41 + i) for i, c in enumerate(_FROM_0X41)}
    out |= {c: chr(0x5F + i) for i, c in enumerate(_FROM_0X5F)}
    out |= {chr(ord(_ZERO) + i): str(i) for i in range(10)}
    return out | _SIGNS


def live_sequences() -> list[tuple[str, str]]:
    """The sequences that can fire: none holds one that is replaced before it."""
    out: list[tuple[str, str]] = []
    for key, value in SEQUENCES:
        if not any(k in key for k, _ in out):
            out.append((key, value))
    return out
