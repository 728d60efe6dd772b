"""Fixed values that results depend on: word lists, labels, patterns."""

#: fixed values: abbreviations after which no sentence ends
ABBREVIATIONS = """a.a. a.e. a.m. al. approx. avg. Avg. cal. ca. cf. cfr. Co. Corp. Dr. Drs. ed. Ed. eds. Eds. Eq. eq. Eqs. etc. Etc.
e.g. fig. Fig. Figs. figs. i.e. ibid. Ibid. Inc. incl. Max. max. Min. min. Mr. Mrs. n. n.d. no. No. Nr. nr. N.B. num. Num. obj.
Obj. pp. p. p.m. prob. Prob. Prof. Ph.D. r.p.m. ref. refs. resp. Ref. Refs. Resp. s.t. S.D. sec. secs. sect. sects. Sec. Secs.
Sect. Sects. sp. spp. St. Std. tel. Tel. uncond. Uncond. U.S. U.S.A. viz. Viz. vol. Vol. VOL. vols. Vols. vs. w.r.t. Jan. Feb.
Apr. Jul. Aug. Sept. Oct. Nov. Dec.""".split()

#: fixed values: canonical section titles, and keywords that stand for them
TITLES = ["Introduction", "Related Work", "Methods", "Materials", "Results", "Discussion", "Conclusion"]
KEYWORDS = {
    "literature review": ["Related Work"],
    "methods and materials": ["Methods", "Materials"],
    "method and material": ["Methods", "Materials"],
    "conclusion": ["Conclusion"],
    "conclusions": ["Conclusion"],
    "previous work": ["Related Work"],
    "previous works": ["Related Work"],
    "results and discussion": ["Results", "Discussion"],
}

#: fixed values: the intent labels in the order of the probabilities, and what stands below the confidence
LABELS = ["usesMethodIn (METHOD)", "obtainsBackgroundFrom (BACKGROUND)", "usesConclusionsFrom (RESULT)"]
UNRELIABLE = "citesForInformation (UNRELIABLE)"
CONFIDENCE, ALIGNED, SIMILAR = 0.9, 0.8, 70.0

#: fixed values: patterns
FORMULA = r"([a-zA-Z]\s*=\s*-?\d+(\.\d+)?([eE][-+]?\d+)?)"
PAGES = r",?\s*p(?:p)?\.?\s+\d+(?:[-–]\d+)?(?:\s*f{2})?"
YEAR_PAGE = r"(?i)\d{4}[^a-z]*?p(?:p)?\.?\s*\d+"
EVAL_DROPPED = "“”‘’\"(),:;{}[]<>«»‹›"
RESULT_COLUMNS = [
    "SECTION", "CITATION", "SCIBERT MET POSITIVE PROBABILITY", "SCIBERT BKG POSITIVE PROBABILITY", "SCIBERT RES POSITIVE PROBABILITY",
    "XLNET MET POSITIVE PROBABILITY", "XLNET BKG POSITIVE PROBABILITY", "XLNET RES POSITIVE PROBABILITY", "MET ENSEMBLE CONFIDENCE",
    "BKG ENSEMBLE CONFIDENCE", "RES ENSEMBLE CONFIDENCE", "FINAL PREDICTION",
]
