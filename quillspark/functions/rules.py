"""The correction rules as data. Order is part of their meaning."""

# Fixed values, in the order in which they apply.
GREEK = "[Ͱ-Ͽἀ-῿]"
OPENING_CLOSING = (("[", "]"), ("(", ")"), ("{", "}"), ("⟨", "⟩"))

# Fixed values: (id, pattern, flags, replacement); i: letters of either case, m: lines.
GENERAL = [
    ("G01", r"^\s*\d{1,4}\s*$", "m", ""),
    ("G02", r"(\w)-\n(\w)", "", r"\1\2"),
    ("G03", r"(\w)- \n(\w)", "", r"\1\2"),
    ("G04", r" {2,}", "", " "),
    ("G05", r" ([,\.\!\?\:\;])(?!\s*\n)", "", r"\1"),
    ("G06", r"\n{3,}", "", '\n\n'),
    ("G07", r"(?<=[a-záéíóúàèìòùäëïöüâêîôûæœ])1(?=[a-záéíóúàèìòùäëïöüâêîôûæœ])", "i", "l"),
    ("G08", r"(?<=[a-záéíóúàèìòùäëïöüâêîôûæœ])0(?=[a-záéíóúàèìòùäëïöüâêîôûæœ])", "i", "o"),
    ("G09", r"(?<=[Ͱ-Ͽἀ-῿])ij|ij(?=[Ͱ-Ͽἀ-῿])", "", "η"),
    ("G10", r"(?<=[Ͱ-Ͽἀ-῿])rj|rj(?=[Ͱ-Ͽἀ-῿])", "", "η"),
    ("G11", r"(?<=[Ͱ-Ͽἀ-῿])cp|cp(?=[Ͱ-Ͽἀ-῿])", "", "φ"),
    ("G12", r"(?<=[Ͱ-Ͽἀ-῿])<p|<p(?=[Ͱ-Ͽἀ-῿])", "", "φ"),
    ("G13", r"(?<=[Ͱ-Ͽἀ-῿])©|©(?=[Ͱ-Ͽἀ-῿])", "", "θ"),
    ("G14", r"(?<=[Ͱ-Ͽἀ-῿]);(?=[Ͱ-Ͽἀ-῿])", "", ""),
    ("G15", r"(?<=[Ͱ-Ͽἀ-῿])[̓̔'](?=[Ͱ-Ͽἀ-῿])", "", ""),
    ("G16", r"\bp p\.\s*(\d)", "", r"pp. \1"),
    ("G17", r"\bI bid\b", "i", "Ibid"),
    ("G18", r"\bop\s*\.\s*cit\s*\.", "", "op. cit."),
    ("G19", r"\t+", "", " "),
    ("G20", r"^\s*[-=\*]{3,}\s*$", "m", ""),
    ("G21", r"\$\$\s*(?=\d)", "", "§§ "),
    ("G22", r"\$\s*(?=\d)", "", "§"),
    ("G23", r"«\s+", "", "« "),
    ("G24", r"\s+»", "", " »"),
    ("G25", r"/9:/", "", "/ɔː/"),
    ("G26", r"\[9:\]", "", "[ɔː]"),
    ("G27", r'/"([a-zA-Zɑ-ɿʀ-ʿ])', "", r"/ʰ\1"),
]

# Errors of single publications, as above.
CORPUS = [
    ("C01", r"Ilioaı", "i", "llioaı"),
    ("C02", r"Ηellenistic", "i", "Ηellenιstιc"),
    ("C03", r"AAλοιρ", "i", "ΑΑλοιρ"),
    ("C04", r"önnoσίων", "i", "önnοσίων"),
    ("C05", r"ἐξetvat", "i", "ἐξetνat"),
    ("C06", r"xeoάσθο", "i", "xeοάσθο"),
    ("C07", r"duyaδεύαντι", "i", "dυyaδεύαντι"),
    ("C08", r"ΙN", "i", "ΙΝ"),
    ("C09", r"Develἢ", "i", "Deνelἢ"),
    ("C10", r"SUMMARΥ", "i", "SUΜΜΑRΥ"),
    ("C11", r"Agteptρίαν", "i", "Αgteρtρίαν"),
    ("C12", r"φαAvgöv", "i", "φαΑνgöν"),
    ("C13", r"XQEOTEQκαὶ", "i", "ΧQΕΟΤΕQκαὶ"),
    ("C14", r"Zußagiται", "i", "Ζυßagιται"),
    ("C15", r"Εéveoc", "i", "Εéνeοc"),
    ("C16", r"SENSΕ", "i", "SΕΝSΕ"),
    ("C17", r"BRΟAD", "i", "ΒRΟΑD"),
    ("C18", r"TΗE", "i", "ΤΗΕ"),
    ("C19", r"Ηesychios", "i", "Ηesychιοs"),
    ("C20", r"BeiAoμαι", "i", "ΒeιΑομαι"),
    ("C21", r"PöAoμαι", "i", "ΡöΑομαι"),
    ("C22", r"CΥPRΙΟT", "i", "CΥΡRΙΟΤ"),
    ("C23", r"NOΝΟΥΣ", "i", "ΝΟΝΟΥΣ"),
    ("C24", r"CΥPRIΟT", "i", "CΥΡRΙΟΤ"),
    ("C25", r"MYCENAΕAN", "i", "ΜYCΕΝΑΕΑΝ"),
    ("C26", r"Ηomeric", "i", "Ηοmerιc"),
    ("C27", r"Ιonic", "i", "Ιοnιc"),
    ("C28", r"Εuboean", "i", "Ευbοean"),
    ("C29", r"ovvavφότεροι", "i", "ovvaνφότεροι"),
    ("C30", r"κἐλευλύvıa", "i", "κἐλευλύνıa"),
    ("C31", r"ivbooßievεἰ", "i", "ivbooßieνεἰ"),
    ("C32", r"acentuaci6n", "i", "acentuación"),
    ("C33", r"absorci6n", "i", "absorción"),
    ("C34", r"pronunciaci6n", "i", "pronunciación"),
    ("C35", r"‘espafiol’", "i", "‘español’"),
    ("C36", r"formulaci6n", "i", "formulación"),
    ("C37", r"relaci6n", "i", "relación"),
    ("C38", r"MNEMOSYNE\s*\(22h\)\s*1526\s*,?\s*4\.17-41a0", "i", "MNEMOSYNE (2021) 1-26"),
    ("C39", r"\bomnioaded\b", "i", "Downloaded"),
    ("C40", r"omnioaded\s+from\s+ΒΗ\s+com(?=\d)", "", "Downloaded from Brill.com"),
    ("C41", r"\bjed\s+from\s+Brill\.com", "", "Downloaded from Brill.com"),
    ("C42", r"\[ΓΟ\b", "", "LOD"),
    ("C43", r"\[ΟΡ\b", "", "LOD"),
    ("C44", r"\bὕπο\s+liste\b", "", "Une liste"),
    ("C45", r"\bὃ\s+(?=\d)", "", "§ "),
    ("C46", r"\bhiAdov\b", "", "hιλάο̄ν"),
    ("C47", r"ht\\aov\s+Cabanes", "", "hίλαον Cabanes"),
    ("C48", r"hlAao\(ç\)\s+Lhôte", "", "hίλαο⟨ς⟩ Lhôte"),
    ("C49", r"\[λα\]ος A", "", "[ἵλα]ος A"),
    ("C50", r"\[lé\s+\(sic\)\s+ὁ\]", "", "[ἰε̄̀ (sic) ο̄̓]"),
    ("C51", r"lédlédièD", "", "ἰὲ ὦ ἰὲ ὦ ἰὲ D"),
    ("C52", r"4\.\s*&\s*\[uäç\]\s+Cabanes,\s+d\[pé\]\s+Lhôte", "", "4. ἁ[μᾶς] Cabanes, ἁ[μέ] Lhôte"),
    ("C53", r"hpuäçEPD", "", "ἡμᾶς E P D"),
    ("C54", r"Βα\s+pavris", "", "hα μάντις"),
    ("C55", r"FavaË\s+Héponches", "", "ϝάναξ Hε̄́ρακλες"),
    ("C56", r"\bdyaodv\b", "", "ἀγαθάν"),
    ("C57", r"=\s*CÉ\.XIL6\.414b-cE\.?", "", "Cf. Σ Il. 6.414b-c E."),
    ("C58", r"Εἰ\s+Ἀλχίμου", "", "Cf. Ἀλκίμου"),
    ("C59", r"\bTodôv\b", "", "ποδο̃ν"),
    ("C60", r"\br\u00e9glement\b", "i", "règlement"),
    ("C61", r"\bdeuxi\u00e9me\b", "i", "deuxième"),
    ("C62", r"\bci-apr\u00e9s\b", "i", "ci-après"),
    ("C63", r"\bderni\u00e9re\b", "i", "dernière"),
    ("C64", r"\bparenth\u00e9ses\b", "i", "parenthèses"),
    ("C65", r"\bcompl\u00e9te\b", "i", "complète"),
    ("C66", r"\bAth\u00e9nes\b", "i", "Athènes"),
    ("C67", r"\bsi\u00e9cle\b", "i", "siècle"),
    ("C68", r"\bpr\u00e9s\b(?=\s+(?:de|du))", "", "près"),
    ("C69", r"\bpres\b(?=\s+(?:de|du))", "i", "près"),
    ("C70", r"\btr\u00e9s\b", "i", "très"),
    ("C71", r"\bLh\u00e9te\b", "", "Lhôte"),
    ("C72", r"Dodone,(?!3)\S", "", "Dodone,3"),
    ("C73", r"religieuses\.(?!4)\S", "", "religieuses.4"),
    ("C74", r"pierre\.(?!5)\S", "", "pierre.5"),
    ("C75", r"Carbon\.(?!7)\S", "", "Carbon.7"),
]

# Rules for runs of Greek, as above.
GREEK_RUN_RULES = [
    ("K01", r"""σ(?=[\s,\.·;:\!\?\)\]\}»'"]|$)""", "m", "ς"),
    ("K02", r"\(ρ", "", "φ"),
    ("K03", r"cp", "", "φ"),
    ("K04", r"<p", "", "φ"),
]

# Literal replacements of characters, in order; only invisible characters are escaped.
CHARS = [
    ("\x93", "“"),  # R01
    ("\x94", "”"),  # R02
    ("\x91", "‘"),  # R03
    ("\x92", "’"),  # R04
    ("\x85", "..."),  # R05
    ("\x96", "–"),  # R06
    ("\x97", "—"),  # R07
    ("\f", "\n"),  # R08
    ("\r\n", "\n"),  # R09
    ("\r", "\n"),  # R10
    ("\xa0", " "),  # R11
    ("\u200b", ""),  # R12
    ("\u200c", ""),  # R13
    ("\ufeff", ""),  # R14
    ("ﬀ", "ff"),  # R15
    ("ﬁ", "fi"),  # R16
    ("ﬂ", "fl"),  # R17
    ("ﬃ", "ffi"),  # R18
    ("ﬄ", "ffl"),  # R19
    ("ﬆ", "st"),  # R20
]

# Whole words.
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

# Look-alikes of a Latin small letter between Greek ones.
IN_GREEK = [("a", "α"), ("b", "β"), ("e", "ε"), ("i", "ι"), ("k", "κ"), ("n", "ν"), ("o", "ο"), ("p", "ρ"), ("r", "ρ"), ("t", "τ"), ("u", "υ"), ("v", "ν"), ("w", "ω"), ("x", "χ")]

# Latin capitals and their Greek look-alikes, as translate() takes them.
EPIGRAPHIC = ("ABDEFGHIKLMNOPQSTVXYZ", "ΑΒΔΕΦΓΗΙΚΛΜΝΟΡΩΣΤΥΧΥΖ")

# Particles that are never joined to a neighbour.
STOPWORDS = {
    "αἱ", "γάρ", "γε", "γὰρ", "δέ", "δὲ", "εἰ", "εἰς", "καί",
    "κατὰ", "καὶ", "μέν", "μή", "μετὰ", "μὲν", "μὴ", "οἱ", "οὐ",
    "οὐδὲ", "οὐκ", "οὐχ", "οὖν", "παρὰ", "πρὸ", "πρὸς", "τε", "τι",
    "τις", "τὰ", "τὸ", "τῇ", "τῷ", "ἀλλὰ", "ἀπὸ", "ἂν", "ἃν",
    "ἄν", "ἄρα", "ἐκ", "ἐν", "ἔτι", "ἡ", "ὁ", "ὅπερ", "ὅπως",
    "ὅσοι", "ὅσον", "ὅστις", "ὅτε", "ὅτι", "ὑπὲρ", "ὑπὸ", "ὡς",
}

# Letters of private use of an old font, epsilon and omicron with circumflex.
PRIVATE_USE = [("\ue1b0", "ε\u0342"), ("\ue1c3", "ο\u0342")]
