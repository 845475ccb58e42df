"""The correction in SQL, stage by stage, with its own statement of what each rule must do; and texts that hold each error.

The SQL engine's patterns have no lookaround: neighbours are captured and put back, twice where matches can share one.
"""

from __future__ import annotations

G, L, N = r"[\x{370}-\x{3ff}\x{1f00}-\x{1fff}]", "[a-záéíóúàèìòùäëïöüâêîôûæœ]", r"[^\p{L}\p{N}_]"

# A text with the error, the error as the SQL engine's patterns say it (%N%: what isn't of a word), and what replaces it.
CORPUS = [
    ("Ilioaı", "(?i)Ilioaı", "llioaı"),  # C01
    ("Ηellenistic", "(?i)Ηellenistic", "Ηellenιstιc"),  # C02
    ("AAλοιρ", "(?i)AAλοιρ", "ΑΑλοιρ"),  # C03
    ("önnoσίων", "(?i)önnoσίων", "önnοσίων"),  # C04
    ("ἐξetvat", "(?i)ἐξetvat", "ἐξetνat"),  # C05
    ("xeoάσθο", "(?i)xeoάσθο", "xeοάσθο"),  # C06
    ("duyaδεύαντι", "(?i)duyaδεύαντι", "dυyaδεύαντι"),  # C07
    ("ΙN", "(?i)ΙN", "ΙΝ"),  # C08
    ("Develἢ", "(?i)Develἢ", "Deνelἢ"),  # C09
    ("SUMMARΥ", "(?i)SUMMARΥ", "SUΜΜΑRΥ"),  # C10
    ("Agteptρίαν", "(?i)Agteptρίαν", "Αgteρtρίαν"),  # C11
    ("φαAvgöv", "(?i)φαAvgöv", "φαΑνgöν"),  # C12
    ("XQEOTEQκαὶ", "(?i)XQEOTEQκαὶ", "ΧQΕΟΤΕQκαὶ"),  # C13
    ("Zußagiται", "(?i)Zußagiται", "Ζυßagιται"),  # C14
    ("Εéveoc", "(?i)Εéveoc", "Εéνeοc"),  # C15
    ("SENSΕ", "(?i)SENSΕ", "SΕΝSΕ"),  # C16
    ("BRΟAD", "(?i)BRΟAD", "ΒRΟΑD"),  # C17
    ("TΗE", "(?i)TΗE", "ΤΗΕ"),  # C18
    ("Ηesychios", "(?i)Ηesychios", "Ηesychιοs"),  # C19
    ("BeiAoμαι", "(?i)BeiAoμαι", "ΒeιΑομαι"),  # C20
    ("PöAoμαι", "(?i)PöAoμαι", "ΡöΑομαι"),  # C21
    ("CΥPRΙΟT", "(?i)CΥPRΙΟT", "CΥΡRΙΟΤ"),  # C22
    ("NOΝΟΥΣ", "(?i)NOΝΟΥΣ", "ΝΟΝΟΥΣ"),  # C23
    ("CΥPRIΟT", "(?i)CΥPRIΟT", "CΥΡRΙΟΤ"),  # C24
    ("MYCENAΕAN", "(?i)MYCENAΕAN", "ΜYCΕΝΑΕΑΝ"),  # C25
    ("Ηomeric", "(?i)Ηomeric", "Ηοmerιc"),  # C26
    ("Ιonic", "(?i)Ιonic", "Ιοnιc"),  # C27
    ("Εuboean", "(?i)Εuboean", "Ευbοean"),  # C28
    ("ovvavφότεροι", "(?i)ovvavφότεροι", "ovvaνφότεροι"),  # C29
    ("κἐλευλύvıa", "(?i)κἐλευλύvıa", "κἐλευλύνıa"),  # C30
    ("ivbooßievεἰ", "(?i)ivbooßievεἰ", "ivbooßieνεἰ"),  # C31
    ("acentuaci6n", "(?i)acentuaci6n", "acentuación"),  # C32
    ("absorci6n", "(?i)absorci6n", "absorción"),  # C33
    ("pronunciaci6n", "(?i)pronunciaci6n", "pronunciación"),  # C34
    ("‘espafiol’", "(?i)‘espafiol’", "‘español’"),  # C35
    ("formulaci6n", "(?i)formulaci6n", "formulación"),  # C36
    ("relaci6n", "(?i)relaci6n", "relación"),  # C37
    ("MNEMOSYNE(22h)1526,4.17-41a0", r"(?i)MNEMOSYNE\s*\(22h\)\s*1526\s*,?\s*4\.17-41a0", "MNEMOSYNE (2021) 1-26"),  # C38
    ("omnioaded", "(?i)(^|%N%)omnioaded($|%N%)", r"\1Downloaded\2"),  # C39
    ("xomnioaded from ΒΗ com7", r"omnioaded\s+from\s+ΒΗ\s+com([0-9])", r"Downloaded from Brill.com\1"),  # C40
    ("jed from Brill.com", r"(^|%N%)jed\s+from\s+Brill\.com", r"\1Downloaded from Brill.com"),  # C41
    ("[ΓΟ", r"\[ΓΟ($|%N%)", r"LOD\1"),  # C42
    ("[ΟΡ", r"\[ΟΡ($|%N%)", r"LOD\1"),  # C43
    ("ὕπο liste", r"(^|%N%)ὕπο\s+liste($|%N%)", r"\1Une liste\2"),  # C44
    ("ὃ 7", r"(^|%N%)ὃ\s+([0-9])", r"\1§ \2"),  # C45
    ("hiAdov", "(^|%N%)hiAdov($|%N%)", r"\1hιλάο̄ν\2"),  # C46
    (r"ht\aov Cabanes", r"ht\\aov\s+Cabanes", "hίλαον Cabanes"),  # C47
    ("hlAao(ç) Lhôte", r"hlAao\(ç\)\s+Lhôte", "hίλαο⟨ς⟩ Lhôte"),  # C48
    ("[λα]ος A", r"\[λα\]ος A", "[ἵλα]ος A"),  # C49
    ("[lé (sic) ὁ]", r"\[lé\s+\(sic\)\s+ὁ\]", "[ἰε̄̀ (sic) ο̄̓]"),  # C50
    ("lédlédièD", "lédlédièD", "ἰὲ ὦ ἰὲ ὦ ἰὲ D"),  # C51
    ("4.&[uäç] Cabanes, d[pé] Lhôte", r"4\.\s*&\s*\[uäç\]\s+Cabanes,\s+d\[pé\]\s+Lhôte", "4. ἁ[μᾶς] Cabanes, ἁ[μέ] Lhôte"),  # C52
    ("hpuäçEPD", "hpuäçEPD", "ἡμᾶς E P D"),  # C53
    ("Βα pavris", r"Βα\s+pavris", "hα μάντις"),  # C54
    ("FavaË Héponches", r"FavaË\s+Héponches", "ϝάναξ Hε̄́ρακλες"),  # C55
    ("dyaodv", "(^|%N%)dyaodv($|%N%)", r"\1ἀγαθάν\2"),  # C56
    ("=CÉ.XIL6.414b-cE.", r"=\s*CÉ\.XIL6\.414b-cE\.?", "Cf. Σ Il. 6.414b-c E."),  # C57
    ("Εἰ Ἀλχίμου", r"Εἰ\s+Ἀλχίμου", "Cf. Ἀλκίμου"),  # C58
    ("Todôv", "(^|%N%)Todôv($|%N%)", r"\1ποδο̃ν\2"),  # C59
    ("réglement", "(?i)(^|%N%)réglement($|%N%)", r"\1règlement\2"),  # C60
    ("deuxiéme", "(?i)(^|%N%)deuxiéme($|%N%)", r"\1deuxième\2"),  # C61
    ("ci-aprés", "(?i)(^|%N%)ci-aprés($|%N%)", r"\1ci-après\2"),  # C62
    ("derniére", "(?i)(^|%N%)derniére($|%N%)", r"\1dernière\2"),  # C63
    ("parenthéses", "(?i)(^|%N%)parenthéses($|%N%)", r"\1parenthèses\2"),  # C64
    ("compléte", "(?i)(^|%N%)compléte($|%N%)", r"\1complète\2"),  # C65
    ("Athénes", "(?i)(^|%N%)Athénes($|%N%)", r"\1Athènes\2"),  # C66
    ("siécle", "(?i)(^|%N%)siécle($|%N%)", r"\1siècle\2"),  # C67
    ("prés de", r"(^|%N%)prés(\s+(?:de|du))", r"\1près\2"),  # C68
    ("pres de", r"(?i)(^|%N%)pres(\s+(?:de|du))", r"\1près\2"),  # C69
    ("trés", "(?i)(^|%N%)trés($|%N%)", r"\1très\2"),  # C70
    ("Lhéte", "(^|%N%)Lhéte($|%N%)", r"\1Lhôte\2"),  # C71
    ("Dodone,x", r"Dodone,[^3\s]", "Dodone,3"),  # C72
    ("religieuses.x", r"religieuses\.[^4\s]", "religieuses.4"),  # C73
    ("pierre.x", r"pierre\.[^5\s]", "pierre.5"),  # C74
    ("Carbon.x", r"Carbon\.[^7\s]", "Carbon.7"),  # C75
]

# Whole words and what replaces them.
WORDS = [
    ("lhéte", "Lhôte"),
    ("dopdonna", "dodona"),
    ("fiir", "für"),
    ("lingiiista", "lingüista"),
    ("geminaciOn", "geminación"),
    ("sefiala", "señala"),
    ("preposiciOn", "preposición"),
    ("sefialé", "señalé"),
    ("oraciOn", "oración"),
    ("negaciOn", "negación"),
    ("variaciOn", "variación"),
    ("entonaciOn", "entonación"),
    ("formulaciOn", "formulación"),
    ("pequenios", "pequeños"),
    ("afios", "años"),
    ("lingiistas", "lingüistas"),
    ("acentuaciOn", "acentuación"),
    ("lingiiisticos", "lingüisticos"),
    ("Filologia", "Filología"),
    ("Lingiiistica", "lingüística"),
    ("Zeitschrifi", "Zeitschrift"),
    ("Zeitschnft", "Zeitschrift"),
    ("G1otta", "Glotta"),
    ("Hespena", "Hesperia"),
    ("Mnemosvne", "Mnemosyne"),
    ("ibid", "ibid."),
    ("Ibid", "Ibid."),
    ("epigratia", "epigrafía"),
    ("epigrafia", "epigrafía"),
    ("fonologia", "fonología"),
    ("morfologa", "morfología"),
    ("inscnpcion", "inscripción"),
    ("inscripcion", "inscripción"),
]

#: Texts for the general rules, brackets, look-alikes, angles, runs of Greek and words.
GENERAL_ERRORS = [
    "\n 12 \n", "exam-\nple", "exam- \nple", "a  b", "hola , mundo ! x .\ny", "a\n\n\n\nb", "wor1d", "n0ne", "λόγijος ijλ", "λrjγ rjω", "λcpα", "<pω ", "©λ", "λό;γος", "λό'γος", "p p. 12", "I bid", "i BID", "op . cit .", "a\t\tb",
    "\n-=-\n", "$$ 12", "$ 4", "«  a", "a  »", "/9:/", "[9:]", '/"a', "πόσ[ισ]ιν λόγοσ (ρα λό(ργος", "<ABC J> <d E> <", "[ ἀγαθ[ο]ῦ ] ( x)", "λόaγος λοrγvος xαx", "lhéte G1otta afios ibid ibid. Ibid xafios", "ﬁn ﬆ\x93a\x94\x85\r\nb",
]
ERRORS = GENERAL_ERRORS + [e for e, _, _ in CORPUS] + [f"({a})" for a, _ in WORDS]


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(texts) -> str:
    return "[" + ", ".join(map(quoted, texts)) + "]"


def regex(c: str, *pairs) -> str:
    for pattern, replacement in pairs:
        c = f"regexp_replace({c}, {quoted(pattern.replace('%N%', N).replace('%G%', G).replace('%L%', L))}, {quoted(replacement)}, 'g')"
    return c


def replaced(c: str, *pairs) -> str:
    for a, b in pairs:
        c = f"replace({c}, {quoted(a)}, {quoted(b)})"
    return c


# Characters and what replaces them.
CHARS = [("\x93", "“"), ("\x94", "”"), ("\x91", "‘"), ("\x92", "’"), ("\x85", "..."), ("\x96", "–"), ("\x97", "—"), ("\f", "\n"), ("\r\n", "\n"), ("\r", "\n"), ("\xa0", " "), ("​", ""), ("‌", ""), ("﻿", ""), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬆ", "st")]
BRACKETS = [(r"\[\s+", "["), (r"\s+\]", "]"), (r"\(\s+", "("), (r"\s+\)", ")"), (r"\{\s+", "{"), (r"\s+\}", "}"), (r"⟨\s+", "⟨"), (r"\s+⟩", "⟩")]
# Look-alikes between Greek letters, and within angles.
LATIN = {"a": "α", "b": "β", "e": "ε", "i": "ι", "k": "κ", "n": "ν", "o": "ο", "p": "ρ", "r": "ρ", "t": "τ", "u": "υ", "v": "ν", "w": "ω", "x": "χ"}
CAPITALS = {"A": "Α", "B": "Β", "D": "Δ", "E": "Ε", "F": "Φ", "G": "Γ", "H": "Η", "I": "Ι", "K": "Κ", "L": "Λ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "Q": "Ω", "S": "Σ", "T": "Τ", "V": "Υ", "X": "Χ", "Y": "Υ", "Z": "Ζ"}
# The general rules.
GENERAL = {
    "G01": [(r"(?m)^\s*[0-9]{1,4}\s*$", "")],
    "G02": [(r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", r"\1\2")],
    "G03": [(r"([\p{L}\p{N}_])- \n([\p{L}\p{N}_])", r"\1\2")],
    "G04": [(r" {2,}", " ")],
    "G05": [(r" ([,.!?:;])([^\S\n]*(?:\z|\S))", r"\1\2")] * 3,
    "G06": [(r"\n{3,}", "\n\n")],
    "G07": [(r"(?i)(%L%)1(%L%)", r"\1l\2")] * 2,
    "G08": [(r"(?i)(%L%)0(%L%)", r"\1o\2")] * 2,
    "G09": [(r"(%G%)ij", r"\1η"), (r"ij(%G%)", r"η\1")],
    "G10": [(r"(%G%)rj", r"\1η"), (r"rj(%G%)", r"η\1")],
    "G11": [(r"(%G%)cp", r"\1φ"), (r"cp(%G%)", r"φ\1")],
    "G12": [(r"(%G%)<p", r"\1φ"), (r"<p(%G%)", r"φ\1")],
    "G13": [(r"(%G%)©", r"\1θ"), (r"©(%G%)", r"θ\1")],
    "G14": [(r"(%G%);(%G%)", r"\1\2")] * 2,
    "G15": [(r"(%G%)[\x{313}\x{314}'](%G%)", r"\1\2")] * 2,
    "G16": [(r"(^|%N%)p p\.\s*([0-9])", r"\1pp. \2")],
    "G17": [(r"(?i)(^|%N%)I bid($|%N%)", r"\1Ibid\2")],
    "G18": [(r"(^|%N%)op\s*\.\s*cit\s*\.", r"\1op. cit.")],
    "G19": [(r"\t+", " ")],
    "G20": [(r"(?m)^\s*[-=\*]{3,}\s*$", "")],
    "G21": [(r"\$\$\s*([0-9])", r"§§ \1")],
    "G22": [(r"\$\s*([0-9])", r"§\1")],
    "G23": [(r"«\s+", "« ")],
    "G24": [(r"\s+»", " »")],
    "G25": [("/9:/", "/ɔː/")],
    "G26": [(r"\[9:\]", "[ɔː]")],
    "G27": [('/"([a-zA-Zɑ-ɿʀ-ʿ])', r"/ʰ\1")],
}


def general(c: str, *ids: str) -> str:
    return regex(c, *[p for i in ids or GENERAL for p in GENERAL[i]])


def chars(c: str) -> str:
    return replaced(c, *CHARS)


def latin(c: str) -> str:
    return regex(c, *[(f"(%G%){a}(%G%)", rf"\1{b}\2") for a, b in LATIN.items()] * 2)


def corpus(c: str) -> str:
    return regex(c, *[(p, r) for _, p, r in CORPUS for _ in range(1 + ("%N%" in p))])


def words(c: str) -> str:
    return regex(c, *[(rf"(^|%N%){a}($|[^\p{{L}}\p{{N}}_.])" if b == a + "." else f"(^|%N%){a}($|%N%)", rf"\1{b}\2") for a, b in WORDS for _ in range(2)])


def sigma(c: str) -> str:
    return regex(c, (r"σ([\)\]\}]|$)", r"ς\1"), (r"\(ρ", "φ"))


def angles(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({c}, '(?s)<[^>]+>|<|[^<]+'), lambda p: CASE WHEN starts_with(p, '<') AND ends_with(p, '>') THEN translate(p, '{''.join(CAPITALS)}', '{''.join(CAPITALS.values())}') ELSE p END), '')"


def segments(c: str, greek: bool = True) -> str:
    found = f"regexp_extract_all({c}, '{G}+(?:[\\[\\](){{}}⟨⟩]{G}+)*|[^{G[1:]}+')"
    return f"array_to_string(list_transform({found}, lambda p: CASE WHEN regexp_matches(p, '^{G}') THEN {sigma('p') if greek else 'p'} ELSE {words('p')} END), '')"


def strip(c: str) -> str:
    return regex(c, (r"^\s+|\s+$", ""))


def fixed(source: str, keep: str, mode: str = "full", with_corpus: bool = True) -> str:
    """CTEs from source (a query with a column t and the columns keep) to f, where t is corrected."""
    stages = [lambda c: f"nfc_normalize({c})", chars, lambda c: regex(c, *BRACKETS), latin, general, *([corpus] if with_corpus else []), angles, lambda c: segments(c, mode != "general"), strip]
    out = [f"f0 AS ({source})"] + [f"f{k} AS (SELECT {keep}, {f('t')} AS t FROM f{k - 1})" for k, f in enumerate(stages, 1)]
    return ", ".join(out) + f", f AS (SELECT * FROM f{len(stages)})"
