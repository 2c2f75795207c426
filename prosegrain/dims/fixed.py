"""Word lists, weights, limits and patterns whose content decides the results.

Patterns are written with ASCII word boundaries in mind; ``functions.exprs.rx`` adapts them
for the JVM, where a plain boundary would also look at non-ASCII letters.
"""

# The pattern registry.
# id, taxonomy id, name, level, heat weight, self amplification, copy playbook, tolerance by genre
REGISTRY = [
    ("importance_inflation", "L-01", "Importance-Puffing Phrases", "lexical", 1.2, "med", True, {"marketing": 1.5, "technical": 0.0, "fiction": 0.0}),
    ("resumptive_phrase", "L-02", "Resumptive/Meta-Transition Phrases", "lexical", 0.7, "high", True, {"technical": 1.3}),
    ("hedging", "L-03", "Hedging Stacks", "lexical", 0.5, "high", True, {"academic": 1.5, "journalism": 0.5, "marketing": 0.3}),
    ("transition_formulaic", "L-04", "Filler Discourse Markers", "lexical", 0.7, "med", True, {"academic": 1.3}),
    ("em_dash_overuse", "L-05", "Em-Dash Overuse", "lexical", 0.6, "med", True, {"journalism": 1.5}),
    ("nominalization", "L-06", "Nominalization Overuse", "lexical", 0.6, "high", False, {"technical": 1.5, "academic": 1.5, "literary-essay": 0.5}),
    ("llm_fingerprint_word", "L-07", "LLM Lexical Fingerprint Words", "lexical", 1.0, "low", True, {}),
    ("tricolon_abstract", "L-08", "Tricolon with Abstracting Third Element", "lexical", 0.8, "high", True, {"marketing": 1.5}),
    ("auxiliary_verb_inflation", "L-09", "Auxiliary Verb Inflation", "lexical", 0.5, "med", False, {"academic": 1.3, "technical": 1.3, "fiction": 0.7}),
    ("personal_pronoun_skew", "L-10", "Personal Pronoun Distribution Skew", "lexical", 0.6, "high", False, {"academic": 1.5, "technical": 1.5, "literary-essay": 0.5, "journalism": 0.7}),
    ("downtoner_divergence", "L-11", "Downtoner Divergence", "lexical", 0.4, "med", False, {"academic": 1.3}),
    ("content_function_ratio", "L-12", "Content-to-Function Word Ratio Imbalance", "lexical", 0.5, "med", False, {"academic": 1.3, "technical": 1.3, "literary-essay": 0.7}),
    ("temporal_sweeping_opener", "L-13", "Temporal Sweeping Openers", "lexical", 0.9, "high", True, {"marketing": 0.5, "journalism": 0.0, "fiction": 0.0, "technical": 0.0}),
    ("epistemic_stance_deficit", "L-14", "Epistemic Stance Marker Deficit", "lexical", 0.4, "low", False, {"technical": 1.5, "academic": 0.7}),
    ("vocabulary_smoothing", "L-15", "Vocabulary Smoothing / Specificity Regression", "lexical", 0.7, "high", False, {"marketing": 1.3}),
    ("elegant_variation", "L-16", "Elegant Variation Compulsion", "lexical", 0.5, "low", False, {"technical": 0.5}),
    ("contraction_fingerprint", "L-17", "Contraction Rate Fingerprint", "lexical", 0.3, "med", False, {"academic": 1.5, "journalism": 0.7}),
    ("intensifier_saturation", "L-18", "Intensifier Saturation", "lexical", 0.6, "med", True, {"marketing": 1.5, "technical": 0.0, "academic": 0.0}),
    ("evasive_complexity", "L-19", "Evasive Complexity Acknowledgment", "lexical", 0.8, "med", False, {"fiction": 0.0, "journalism": 0.0, "marketing": 0.0}),
    ("binary_contrast", "S-01", "Binary Contrast Construction", "sentence", 0.8, "high", True, {"marketing": 1.5}),
    ("participial_cascade", "S-02", "Present Participial Cascade", "sentence", 1.0, "high", False, {}),
    ("clause_symmetry", "S-03", "Balanced Clause Symmetry", "sentence", 0.8, "med", False, {"technical": 1.3}),
    ("that_subject", "S-04", "That-Subject Constructions", "sentence", 0.5, "med", False, {}),
    ("sentence_length_clustering", "S-05", "Sentence Length Clustering", "sentence", 0.9, "high", True, {}),
    ("exhaustive_setup", "S-06", "The Exhaustive Setup Sentence", "sentence", 0.9, "high", False, {"technical": 1.5}),
    ("phrasal_coordination_chain", "S-07", "Phrasal Coordination Chains", "sentence", 0.6, "med", False, {}),
    ("agentless_passive", "S-08", "Agentless Passive Voice", "sentence", 0.5, "med", False, {"academic": 1.5, "technical": 1.3}),
    ("imperative_opening", "S-09", "The Imagine/Consider/Picture This Opening", "sentence", 0.6, "high", False, {}),
    ("definitional_opening", "S-10", "The Definitional Opening", "sentence", 0.8, "med", False, {"technical": 1.3}),
    ("subordinate_clause_inflation", "S-11", "Subordinate Clause Inflation", "sentence", 0.6, "med", False, {"academic": 1.5, "technical": 1.3}),
    ("clausal_coordination_divergence", "S-12", "Clausal Coordination Divergence", "sentence", 0.5, "med", False, {}),
    ("dependency_distance_deficit", "S-13", "Dependency Distance Optimization Deficit", "sentence", 0.5, "low", False, {"academic": 1.3}),
    ("sentence_opener_repetition", "S-14", "Sentence Opener Diversity Reduction", "sentence", 0.7, "high", False, {}),
    ("punctuation_skew", "S-15", "Punctuation Distribution Skew", "sentence", 0.4, "low", False, {"technical": 1.3, "academic": 1.3}),
    ("monolithic_tense", "S-16", "Monolithic Tense Anchoring", "sentence", 0.5, "high", False, {"technical": 1.5}),
    ("cataphoric_deficit", "S-17", "Cataphoric Reference Deficit", "sentence", 0.4, "high", False, {"technical": 2.0, "fiction": 0.5}),
    ("concessive_while", "S-18", "Concessive While X, Y Overuse", "sentence", 0.6, "high", True, {"academic": 1.3}),
    ("weak_verb_padding", "S-19", "Weak Verb Padding", "sentence", 0.6, "med", False, {"marketing": 0.5}),
    ("additive_negative_parallelism", "S-20", "Additive Negative Parallelism (Not Just X, But Y)", "sentence", 0.5, "low", True, {"marketing": 1.5}),
    ("general_specific_evaluative", "P-01", "General→Specific→Evaluative Arc Repetition", "paragraph", 0.8, "high", False, {}),
    ("resolution_complete", "P-02", "Paragraph-Internal Resolution Compulsion", "paragraph", 0.5, "high", False, {"technical": 1.5}),
    ("uniform_paragraph_length", "P-03", "Uniform Paragraph Length", "paragraph", 0.8, "high", True, {}),
    ("topic_sentence_first", "P-04", "The Topic-Sentence-First Compulsion", "paragraph", 0.7, "high", False, {"journalism": 1.3, "technical": 1.3}),
    ("concluding_summary", "P-05", "The Concluding-Summary Paragraph", "paragraph", 0.6, "high", True, {}),
    ("parallel_paragraph_structure", "P-06", "Parallel Paragraph Structure Across Points", "paragraph", 0.9, "high", False, {"technical": 1.5}),
    ("vignette_then_principle", "P-07", "The Vignette-Then-Principle Opening", "paragraph", 0.7, "high", False, {}),
    ("dense_but_disconnected", "P-08", "Dense but Disconnected (Metapragmatic Link Deficit)", "paragraph", 0.7, "med", False, {"technical": 1.3}),
    ("markdown_compulsion", "P-09", "Markdown/Formatting Compulsion in Prose", "paragraph", 0.6, "med", True, {"technical": 2.0, "code": 2.0}),
    ("generic_specificity", "P-10", "Generic Specificity (Plausible but Empty Examples)", "paragraph", 0.7, "med", True, {}),
    ("rst_discourse_skew", "P-11", "RST Discourse-Relation Skew", "paragraph", 0.5, "med", False, {"technical": 1.3}),
    ("inline_header_lists", "P-12", "Inline-Header Vertical Lists", "paragraph", 0.5, "high", False, {"technical": 1.5}),
    ("emotional_positivity_bias", "D-07", "Emotional Positivity Bias / Negative Affect Suppression", "document", 0.6, "high", True, {"marketing": 1.5, "fiction": 0.5}),
    ("readability_uniformity", "D-08", "Vocabulary/Readability Uniformity", "document", 0.5, "high", False, {"technical": 1.3}),
    ("specificity_gradient_flat", "D-09", "Specificity Gradient Flattening", "document", 0.6, "high", False, {"marketing": 1.5}),
    ("cross_domain_rigidity", "D-10", "Cross-Domain Stylistic Rigidity", "document", 0.5, "high", False, {}),
    ("idiom_avoidance", "L-20", "Idiom and Colloquialism Avoidance", "lexical", 0.5, "med", False, {"academic": 2.0, "technical": 1.5, "fiction": 0.5, "journalism": 0.5}),
    ("copula_substitution", "L-21", "Copula Substitution (Serves As Dodge)", "lexical", 0.6, "high", False, {}),
    ("marketing_register_leak", "L-22", "Marketing Action Verbs as Default Register", "lexical", 0.7, "high", True, {"marketing": 2.0, "technical": 0.0, "academic": 0.0}),
    ("spectral_vocabulary_palette", "L-23", "Ghostly-Spectral Vocabulary Palette (Fiction)", "lexical", 0.8, "high", False, {"fiction": 1.0, "technical": 0.0, "academic": 0.0, "journalism": 0.0}),
    ("character_name_convergence", "L-24", "Fictional Character Name Convergence", "lexical", 0.5, "med", False, {"fiction": 1.0, "technical": 0.0, "academic": 0.0}),
    ("invented_concept_label", "L-25", "Invented Concept Labels", "lexical", 0.7, "med", False, {"academic": 0.5}),
    ("negation_reframe", "S-21", "Negation-Reframe Construction (\"It's Not X — It's Y\")", "sentence", 1.0, "high", True, {"marketing": 1.3}),
    ("rhetorical_qa_cadence", "S-22", "Self-Posed Rhetorical Q&A Cadence", "sentence", 0.7, "high", False, {"journalism": 1.3}),
    ("svo_rigidity", "S-23", "SVO Word Order Rigidity", "sentence", 0.5, "med", False, {"technical": 1.5, "academic": 1.3}),
    ("over_explanation", "S-24", "Over-Explanation and Parenthetical Definitions", "sentence", 0.6, "high", True, {"technical": 0.5, "academic": 0.5}),
    ("forced_synesthesia", "S-25", "Forced Synesthesia / Abstract-Concrete Collision (Fiction)", "sentence", 0.8, "high", False, {"fiction": 1.0, "technical": 0.0, "academic": 0.0}),
    ("whether_universal_closer", "S-26", "Whether Universal Closer", "sentence", 0.7, "high", False, {"marketing": 1.5}),
    ("blocky_scene_architecture", "P-13", "Blocky Scene Architecture (Fiction)", "paragraph", 0.6, "med", False, {"fiction": 1.0}),
    ("listicle_in_trenchcoat", "P-14", "Listicle in a Trench Coat", "paragraph", 0.7, "med", False, {"technical": 1.5}),
    ("manufactured_fragments", "P-15", "Manufactured Single-Sentence Paragraphs", "paragraph", 0.5, "high", True, {"journalism": 1.3, "fiction": 1.3}),
    ("grammatical_perfection", "D-11", "Grammatical Perfection (Error Absence)", "document", 0.3, "low", False, {"academic": 2.0, "technical": 2.0}),
    ("digression_absence", "D-12", "Digression Absence (Relentless Linearity)", "document", 0.6, "high", False, {"technical": 1.5, "academic": 1.3}),
    ("vocabulary_collapse_over_length", "D-13", "Vocabulary Collapse Over Document Length", "document", 0.6, "high", False, {}),
    ("sycophantic_closing", "D-14", "Sycophantic and Motivational Closings", "document", 0.8, "high", True, {"marketing": 1.5}),
    ("interactional_metadiscourse_deficit", "D-15", "Reduced Interactional Metadiscourse", "document", 0.5, "high", False, {"technical": 1.5, "academic": 1.0}),
    ("cross_model_consensus", "D-16", "Cross-Model Consensus Signature", "document", 0.4, "low", False, {}),
]

# The patterns whose density is reported per window.
DENSITY_PATTERNS = [
    "importance_inflation", "resumptive_phrase", "hedging", "transition_formulaic",
    "em_dash_overuse", "nominalization", "llm_fingerprint_word", "tricolon_abstract",
    "binary_contrast", "participial_cascade", "clause_symmetry", "that_subject",
    "sentence_length_clustering", "exhaustive_setup", "phrasal_coordination_chain",
    "agentless_passive", "imperative_opening", "definitional_opening",
    "general_specific_evaluative", "resolution_complete", "uniform_paragraph_length",
    "topic_sentence_first", "concluding_summary", "parallel_paragraph_structure",
    "vignette_then_principle",
]

# Density limits. pattern, window words, max count, unit
DENSITY_THRESHOLDS = [
    ("importance_inflation", 1000, 0, "count"),
    ("resumptive_phrase", 800, 1, "count"),
    ("hedging", 200, 1, "count"),
    ("transition_formulaic", 300, 1, "count"),
    ("em_dash_overuse", 250, 1, "count"),
    ("llm_fingerprint_word", 500, 1, "count"),
    ("tricolon_abstract", 400, 1, "count"),
    ("temporal_sweeping_opener", 1000, 1, "count"),
    ("intensifier_saturation", 300, 2, "count"),
    ("marketing_register_leak", 500, 1, "count"),
    ("binary_contrast", 1000, 4, "per_1000_words"),
    ("sentence_length_clustering", 500, 3, "count"),
    ("concessive_while", 1000, 4, "per_1000_words"),
    ("additive_negative_parallelism", 800, 1, "count"),
    ("negation_reframe", 200, 1, "count"),
    ("over_explanation", 500, 1, "count"),
    ("uniform_paragraph_length", 500, 2, "count"),
    ("concluding_summary", 800, 1, "count"),
    ("manufactured_fragments", 500, 2, "count"),
    ("markdown_compulsion", 500, 1, "count"),
    ("generic_specificity", 500, 2, "count"),
    ("emotional_positivity_bias", 2000, 1, "count"),
]

# Window sets. name, least words, target words, step in sentences
WINDOW_SETS = [("narrow", 50, 75, 1), ("medium", 200, 350, 7), ("wide", 1000, 1500, 30)]
# Which window set a pattern level is checked on.
LEVEL_WINDOW = {"lexical": "narrow", "sentence": "medium", "paragraph": "medium", "document": "wide"}
# Sliding word windows by level. words, stride
WORD_WINDOWS = {"lexical": (200, 100), "sentence": (300, 150), "document": (1000, 500), "genre": (500, 250)}

# Abbreviations that do not end a sentence.
ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr st vs etc inc ltd co corp jan feb mar apr jun jul aug sep oct nov dec "
    "vol dept univ assn bros rep sen gov gen sgt cpl pvt capt lt col cmdr adm maj drs rev hon fig eq "
    "approx appt est i.e e.g cf al"
).split()

# Function words.
FUNCTION_WORDS = (
    "the a an this that these those in on at to for with from by of about and or but nor yet so "
    "i you he she it we they me him her us them is are was were be been being have has had do does did "
    "will would shall should may might can could must not no if then than as while when where how"
).split()

# The lexical screen. pattern, expression, confidence
SCREEN_RULES = [
    ("transition_formulaic", r"^(Moreover|Furthermore|Additionally|In conclusion|In essence)\b", 0.85),
    ("llm_fingerprint_word", r"\b(delve|landscape|tapestry|multifaceted|nuanced)\b", 0.85),
    ("importance_inflation", r"\b(crucial|fundamental|pivotal|groundbreaking|tremendous|essential)\b", 0.85),
    ("hedging", r"\b(perhaps|might|somewhat|potentially|considerable|promising|significant)\b", 0.85),
]
# The rule validators.
VALIDATOR_RULES = [
    ("nominalization", r"\b\w+(tion|ment|ness|ity)\b"),
    ("hedging", SCREEN_RULES[3][1]),
    ("binary_contrast", r"\b(while|although|whereas|both\s+\w+\s+and)\b"),
    ("importance_inflation", SCREEN_RULES[2][1]),
    ("transition_formulaic", SCREEN_RULES[0][1]),
    ("llm_fingerprint_word", SCREEN_RULES[1][1]),
    ("agentless_passive", r"\b(is|was|are|were)\s+(considered|implemented|achieved|conducted|recognized)\b"),
]

# Word lists of the rule classifier.
STRONG_WORDS = (
    "truly fundamental remarkable unprecedented undoubtedly crucial powerful cutting-edge significant "
    "essential very clearly decisively sharper strongest transformative"
).split()
STAKES_WORDS = ["crucial", "essential", "significant"]
NOMINAL_WORDS = (
    "utilization implementation optimization facilitation democratization establishment recognition "
    "realization transformation integration advancement development"
).split()
COMMON_WORDS = (
    "the and that this with when from into only they their there will while where what about should"
).split()
CONTRAST_RE = r"\bwhile\b|\bnot\b.+?\bbut\b|\brather than\b|\binstead of\b"
RULE_HEAT_WEIGHTS = {
    "intensifier_saturation": 1.5, "importance_inflation": 1.1, "binary_contrast": 1.4,
    "sentence_opener_repetition": 1.2, "nominalization": 1.0, "vocabulary_smoothing": 0.8,
}

# The tier vocabularies.
GATE_IDS = [
    "binary_contrast", "nominalization", "hedging", "sentence_opener_repetition",
    "importance_inflation", "transition_formulaic", "llm_fingerprint_word", "participial_cascade",
]
MEDIUM_IDS = GATE_IDS + ["agentless_passive", "resumptive_phrase", "tricolon_abstract"]

# Marker families scanned in fast mode.
FAST_MARKERS = (
    "abstract_noun additive_transition balanced_formula capability_claim chatbot_signoff chatgpt_quirk "
    "claude_quirk compare_contrast_frame contrastive_formula contrastive_negation emphasis_transition "
    "empty_conclusion erudite_adjective gemini_quirk hedge_phrase hedged_transition hyperbolic_adjective "
    "persona_flattening safety_disclaimer signposting_filler spatial_metaphor stereotyped_opener "
    "superlative sycophantic_opener vague_contextualizer"
).split()
# What marks a bundled expression, and the labels of bundled and of manual phrases.
BUNDLE_MARK = "A-Za-z0-9_"
SOURCE_LABELS = ["oai_regex_bundle", "kimi_field_manual"]
# Candidates kept per sentence by mode.
MODE_CAPS = {"fast": 4, "tiered": 8, "exhaustive": 20}
# Words too common to trigger a scan.
COMMON_TRIGGERS = (
    "about above across against also because between could does from have into more most other should "
    "that their there these this through while with within would"
).split()

# Marker family to pattern types.
MARKER_TYPES = {
    "abstract_noun": "llm_fingerprint_word evasive_complexity generic_specificity",
    "academic_transition": "transition_formulaic llm_fingerprint_word",
    "additive_transition": "transition_formulaic",
    "aspirational_noun": "marketing_register_leak importance_inflation",
    "balanced_formula": "clause_symmetry binary_contrast",
    "capability_claim": "marketing_register_leak importance_inflation",
    "chatbot_signoff": "sycophantic_closing emotional_positivity_bias",
    "chatgpt_quirk": "llm_fingerprint_word",
    "claude_quirk": "llm_fingerprint_word",
    "compare_contrast_frame": "binary_contrast clause_symmetry",
    "content_farm_formula": "listicle_in_trenchcoat generic_specificity",
    "contrastive_formula": "binary_contrast",
    "contrastive_negation": "negation_reframe binary_contrast",
    "emphasis_transition": "transition_formulaic importance_inflation",
    "empowerment_verb": "marketing_register_leak",
    "empty_conclusion": "concluding_summary sycophantic_closing",
    "encouragement_phrase": "emotional_positivity_bias sycophantic_closing",
    "engagement_bait": "marketing_register_leak listicle_in_trenchcoat",
    "engagement_deficit": "interactional_metadiscourse_deficit",
    "erudite_adjective": "llm_fingerprint_word importance_inflation",
    "excess_noun": "nominalization evasive_complexity",
    "faux_balance": "binary_contrast concessive_while",
    "formal_verb": "llm_fingerprint_word weak_verb_padding",
    "gemini_quirk": "llm_fingerprint_word",
    "hedge_phrase": "hedging",
    "hedge_uplink_combo": "hedging importance_inflation",
    "hedged_complexity": "hedging evasive_complexity",
    "hedged_transition": "transition_formulaic hedging",
    "hyperbolic_adjective": "importance_inflation intensifier_saturation",
    "impact_verb": "importance_inflation weak_verb_padding",
    "innovation_adjective": "marketing_register_leak importance_inflation",
    "journey_metaphor": "marketing_register_leak spectral_vocabulary_palette",
    "listicle_frame": "listicle_in_trenchcoat",
    "meta_commentary": "resumptive_phrase interactional_metadiscourse_deficit",
    "outcome_inflator": "importance_inflation",
    "outcome_noun": "marketing_register_leak nominalization",
    "paragraph_template": "parallel_paragraph_structure general_specific_evaluative",
    "persona_flattening": "sycophantic_closing interactional_metadiscourse_deficit",
    "process_noun": "nominalization",
    "pseudo_empathy": "emotional_positivity_bias sycophantic_closing",
    "rlhf_artifact": "sycophantic_closing llm_fingerprint_word",
    "safety_disclaimer": "sycophantic_closing generic_specificity",
    "scholarly_adverb": "llm_fingerprint_word",
    "scope_inflator": "importance_inflation evasive_complexity",
    "search_optimizer": "listicle_in_trenchcoat generic_specificity",
    "significance_claim": "importance_inflation",
    "signposting_filler": "transition_formulaic resumptive_phrase",
    "sophistication_adjective": "llm_fingerprint_word importance_inflation",
    "spatial_metaphor": "llm_fingerprint_word spectral_vocabulary_palette",
    "stereotyped_opener": "temporal_sweeping_opener transition_formulaic",
    "strategy_verb": "marketing_register_leak weak_verb_padding",
    "structural_padding": "over_explanation resumptive_phrase",
    "superlative": "importance_inflation intensifier_saturation",
    "sycophancy_pattern": "sycophantic_closing emotional_positivity_bias",
    "sycophantic_opener": "sycophantic_closing",
    "synergy_marker": "marketing_register_leak llm_fingerprint_word",
    "temporal_framer": "temporal_sweeping_opener",
    "title_template": "listicle_in_trenchcoat generic_specificity",
    "triadic_list": "tricolon_abstract phrasal_coordination_chain",
    "uplift_formula": "emotional_positivity_bias marketing_register_leak",
    "vague_contextualizer": "generic_specificity temporal_sweeping_opener",
    "voice_flattening": "interactional_metadiscourse_deficit readability_uniformity",
}

# Swaps for overused words. from, to
SWAPS = [
    ("delve", "look at / examine"), ("leverage", "use"), ("utilize", "use"),
    ("synergy", "combined effect"), ("optimize", "improve / tune"), ("streamline", "simplify"),
    ("empower", "enable / let"), ("innovative", "new / first to"),
    ("groundbreaking", "first to demonstrate"), ("transformative", "measurable change in"),
    ("landscape", "market / field"), ("harness", "use"), ("unlock", "open / enable"),
    ("unleash", "release / enable"), ("seamless", "smooth / without friction"),
    ("cutting-edge", "recent / current"), ("game-changer", "shifted how X works"),
    ("paradigm", "model / approach"), ("unprecedented", "first since / unlike prior"),
    ("elevate", "raise / improve"), ("foster", "build / support"),
    ("showcase", "show / demonstrate"), ("robust", "reliable / stable"),
    ("holistic", "full-picture / end-to-end"), ("actionable", "specific next step"),
]
# Banned words.
BANNED_WORDS = (
    "delve leverage synergy optimize streamline empower innovative groundbreaking transformative utilize "
    "landscape harness unlock unleash seamless cutting-edge game-changer paradigm unprecedented elevate "
    "commence foster showcase vibrant robust scalable holistic actionable best-in-class world-class "
    "mission-critical"
).split()

# Playbook layers. id, label, patterns
PLAYBOOK_LAYERS = [
    ("lexical", "Word-level", "importance_inflation hedging llm_fingerprint_word intensifier_saturation transition_formulaic marketing_register_leak"),
    ("phrase", "Phrase-level", "binary_contrast negation_reframe resumptive_phrase concessive_while additive_negative_parallelism temporal_sweeping_opener"),
    ("structural", "Structural", "tricolon_abstract sentence_length_clustering concluding_summary uniform_paragraph_length manufactured_fragments"),
    ("tone", "Tone", "emotional_positivity_bias hedging"),
    ("formatting", "Formatting", "em_dash_overuse markdown_compulsion"),
    ("content", "Content", "generic_specificity over_explanation"),
]
# Audit checks. id, label, automated
AUDIT_CHECKS = [
    ("em_dash", "Em dash scan", True), ("worst_words", "15 worst words scan", True),
    ("lexicon_scan", "Lexicon swap scan", True), ("binary_reframe", "Binary reframe scan", True),
    ("formal_transitions", "Formal transition scan", True),
    ("meta_commentary", "Meta-commentary scan", True), ("vague_ending", "Vague ending scan", True),
    ("three_item_list", "Three-item list check", True),
    ("paragraph_opener", "Paragraph opener variety", True),
    ("contraction", "Contraction check", True), ("read_aloud", "Read-aloud test", False),
    ("so_what", 'The "so what" test', False), ("and_test", 'The "and" test', False),
]
# Audit expressions.
BINARY_REFRAME_RE = r"\b(it'?s|this is) not\b[^.!?]{0,80}\b(it'?s|but)\b|\bnot (simply|just|only)\b[^.!?]{0,60}\bbut\b"
FORMAL_TRANSITION_RE = r"(?:^|[.!?]\s+)(Furthermore|However|Moreover|Therefore)\b"
META_COMMENTARY_RE = r"\b(in this article|let me explain|in conclusion|to summarize|in today's)\b"
VAGUE_ENDING_RE = r"\b(the future looks bright|the possibilities are endless|only time will tell)\b"
THREE_ITEM_RE = r"[^.!?\n]+[,;][^.!?\n]+[,;][^.!?\n]+\band\b[^.!?\n]*"
STIFF_FORM_RE = r"\b(do not|cannot|will not|you are|we are|they are|it is)\b"

# Opposition templates, in the order they are tried. name, expression, reason
OPPOSITION_TEMPLATES = [
    ("not_about", r"\bnot about\b[^.!?]{0,120}(?:\bbut(?:\s+about)?\b|[,;:—-]\s*(?:(?:it'?s|it is|this is|that is)\s+)?about\b)", "Generic not-about-but-about opposition without a real opposing position."),
    ("not_but", r"\b(?:it'?s|this is|that is|they are|we are)\s+not\b[^.!?]{0,100}\b(?:but|rather|instead)\b", "Template not-X-but-Y contrast without specific evidence."),
    ("not_simply_but", r"\bnot (?:simply|just|only|merely)\b[^.!?]{0,80}\bbut\b", "Template not-X-but-Y contrast without specific evidence."),
    ("most_best", r"\bmost\b[^.!?]{0,80}\b(?:the best|winners|leaders)\b", "Generic most-versus-best strawman contrast."),
    ("one_hand", r"\bon (?:the )?one hand\b", "Formulaic on-the-one-hand scaffolding."),
    ("other_hand", r"\bon the other hand\b", "Formulaic on-the-other-hand scaffolding."),
]
OPPOSITION_SIGNAL_RE = r"\b(but|rather than|instead of|not about|it's not|is not|on the other hand|while\b[^.!?]{0,60},)"
OPPOSITION_TYPES = ["binary_contrast", "negation_reframe", "concessive_while", "clause_symmetry"]

# Suggestion and meaning checks.
PLACEHOLDER_RE = r"please (supply|provide|give|restructure)|\[.*?\]|TODO|placeholder"
FOREIGN_SCENE_RE = r"\b(skyline|tower|towers|warehouse|corporate headquarters|financial district|steel and glass|channel\s*\d|gleaming spire)\b"
NEGATION_RE = r"\bnot\b|n't\b"
CERTAINTY_RE = r"\b(undoubtedly|unquestionably|always\b|never\b|proves?\b|certainly|definitively|guaranteed|indisputable)\b"
INTENSIFIER_RE = r"\b(extremely|incredibly|absolutely|totally|utterly|profoundly|unbelievably)\b"

# Style guides. name, description, length mean, std, min, max, nominalization,
# participial, balance, same arc, resolution, contrast min, contrast max, rho, entropy,
# inflation, transitions, continuity
GUIDE_COLUMNS = (
    "name description len_mean len_std len_min len_max nominalization_max participial_max max_balance "
    "max_consecutive_same resolution_target contrast_min contrast_max max_rho entropy_min "
    "inflation_max transition_max continuity"
).split()
GUIDES = [
    ("general", "Reduce LLM uniformity across all dimensions", 16.0, 10.0, 3.0, 45.0, 0.1, 0.05, 0.8, 2, 0.7, 1.0, 4.0, 0.3, 2.5, 0.02, 0.15, 0.5),
    ("literary-essay", "Wide variance, high device entropy, tolerance for unresolved tension", 18.0, 12.0, 3.0, 55.0, 0.08, 0.03, 0.75, 2, 0.6, 1.0, 3.0, 0.25, 2.8, 0.02, 0.1, 0.3),
    ("technical", "High continuity, parallel structure tolerated, low nominalization", 20.0, 8.0, 5.0, 40.0, 0.06, 0.04, 0.85, 3, 0.8, 0.0, 5.0, 0.35, 2.0, 0.01, 0.2, 0.7),
    ("journalism", "Short sentences, high rhythm variance, minimal hedging", 14.0, 10.0, 2.0, 35.0, 0.05, 0.02, 0.7, 2, 0.5, 1.0, 3.0, 0.2, 2.5, 0.01, 0.05, 0.2),
    ("fiction", "Maximum device entropy, lowest formulaicness, widest sentence length range", 15.0, 14.0, 1.0, 60.0, 0.04, 0.03, 0.65, 1, 0.4, 0.0, 2.0, 0.15, 3.0, 0.005, 0.03, 0.1),
]

# Paragraph targets. purpose, entropy min, entropy max, std min, max rho, resolution
PURPOSE_TARGETS = [
    ("analytical", 2.0, 4.0, 8.0, 0.25, False), ("narrative", 1.5, 3.5, 10.0, 0.35, False),
    ("argumentative", 2.2, 4.0, 7.0, 0.2, True), ("transitional", 1.0, 3.0, 4.0, 0.4, False),
    ("summary", 1.5, 3.0, 5.0, 0.3, True), ("example", 1.8, 3.5, 8.0, 0.3, False),
    ("definition", 1.5, 3.0, 5.0, 0.35, True),
]

# Text blocks of a rich-text tree.
BLOCK_TYPES = ["paragraph", "heading", "listItem", "blockquote", "codeBlock"]
# Register dimensions in tie order.
REGISTERS = ["informational", "involved", "narrative", "persuasive", "abstract", "elaborative"]

# Phrase rules for the soften and compact rewrites. step, expression, replacement
SOFTEN_RULES = [
    (r"\bhas perhaps arguably created\b", "may have created"),
    (r"\bPerhaps more importantly,\s*the\b", "The"),
    (r"\btruly fundamental paradigm shift\b", "important change"),
    (r"\bvery foundations\b", "basic assumptions"),
    (r"\bremarkable potential\b", "practical potential"),
    (r"\bvirtually every\b", "many"),
    (r"\bPerhaps more importantly,\s*", ""),
    (r"\bperhaps arguably\b", "arguably"),
    (r"\bunprecedented opportunities\b", "new opportunities"),
    (r"\bpowerful tools\b", "useful tools"),
    (r"\bcutting-edge technologies\b", "new technologies"),
    (r"\bparticularly noteworthy\b", "worth noting"),
    (r"\buniquely favorable\b", "favorable"),
    (r"\bundoubtedly play a crucial role\b", "will likely matter"),
    (r"\bstrongest expressions\b", "strongest expressions"),
    (r"\btruly deserve\b", "deserve"),
]
COMPACT_RULES = [
    (r"\bhas demonstrated\b", "shows"), (r"\bhas enabled\b", "enables"),
    (r"\bhas been crucial in driving\b", "helps"), (r"\bwill likely play\b", "will likely matter in"),
]
BINARY_RULE = (r"^(.+?) is not about (.+?) but about (.+?)([.!?])$", "$1 means $3$4 It avoids $2.")

# Starting word lists of the statistical detectors.
LEXICONS = {
    "importance": ["stands as a testament to", "a pivotal moment in", "it's worth noting that", "a profound impact on", "a cornerstone of", "it cannot be overstated", "a watershed moment", "a rich tapestry of"],
    "resumptive": ["in other words", "put simply", "essentially", "that is to say", "to put it another way", "in essence", "simply put", "at its core", "the bottom line is", "what this means is"],
    "hedge": ["perhaps", "might", "somewhat", "potentially", "considerable", "promising", "significant"],
    "filler_opener": ["moreover", "furthermore", "additionally", "indeed", "notably", "importantly", "certainly", "undoubtedly", "interestingly", "crucially"],
    "downtoner": ["barely", "nearly", "slightly", "somewhat", "hardly", "merely", "scarcely", "rather", "almost", "only just"],
    "sweeping_opener": ["in today's world", "throughout history", "in the modern era", "since the dawn of civilization", "in an increasingly interconnected world", "in recent years", "as we stand at the crossroads of"],
    "epistemic": ["perhaps", "it seems likely", "in my view", "i suspect", "to the best of my knowledge", "as far as i can tell"],
    "institutional_hedge": ["it's important to note", "it is important to note", "it is worth noting"],
    "contraction": ["don't", "can't", "it's", "they're"],
    "intensifier": ["absolutely", "incredibly", "extremely", "definitely", "certainly", "undoubtedly", "really", "very", "truly", "remarkably"],
    "imperative": ["imagine", "consider", "picture this"],
    "padded_verb": ["helps with", "plays a role in", "is aimed at", "can be used to", "serves as", "works to", "is focused on", "contributes to"],
    "summary_marker": ["in summary", "overall", "taken together", "in conclusion"],
    "link_bundle": ["which means that", "the reason is", "this connects to", "as a result of"],
    "name": ["elara", "kael", "sarah chen"],
    "positive": ["joy", "delight", "hope", "happy", "bright"],
    "negative": ["fear", "disgust", "anger", "sad", "dread"],
    "visual": ["bright", "dark", "glow", "shadow", "colour"],
    "auditory": ["loud", "quiet", "whisper", "echo", "hum"],
    "tactile": ["rough", "smooth", "cold", "warm", "soft"],
    "olfactory": ["smell", "scent", "odour", "fragrant", "musty"],
    "gustatory": ["sweet", "bitter", "sour", "salty", "taste"],
}
EVASIVE_RE = r"\b(?:is|are|was|were|remains?)\s+(?:\w+\s+){0,4}?(?:complex|nuanced|multifaceted)\b|\bonly scratched the surface\b|\bmultifaceted nature\b"
DEFINITION_RE = r"\b(?:is defined as|refers to|at its core)\b"
PREVIEW_RE = r"\b(?:two|three|four|five|six|several|many|key)\s+(?:\w+\s+)?(?:factors|components|reasons|ways|elements|aspects)\b|^[^:]{20,}:\s"
PASSIVE_RE = r"\b(?:is|was|are|were|be|been|being)\s+\w+ed\b"
PARTICIPLE_RE = r"\b[a-z]{3,}ing\b"
PARALLEL_RE = r"\b(?:not only|not just|not merely)\b.*?\b(?:but also|but furthermore|but)\b"
WHETHER_RE = r"\bwhether\b.*\bor\b"
MARKUP_RE = r"\*\*|(?:^|\n)#{1,6}\s|(?:^|\n)\s*(?:[-*]|\d+\.)\s|`[^`]+`"
HEADER_ITEM_RE = r"^\s*(?:\d+[.)]|[-*•])\s+(?:\*\*[^*]+\*\*\s*:|\*\*[^*]+:\*\*)"

# Editorial settings as directive lines. field, value, line
DIRECTIVES = [
    ("statement_force", "tentative", "Statement force: tentative — qualify claims, prefer hedged wording over assertion."),
    ("statement_force", "measured", "Statement force: measured — state claims plainly, avoid both hedging and emphasis."),
    ("statement_force", "firm", "Statement force: firm — state claims directly without hedging, no superlative reinforcement."),
    ("statement_force", "emphatic", "Statement force: emphatic — state claims with conviction; one strongest expression is permitted if evidence-bearing."),
    ("claim_certainty", "qualify", "Claim certainty: qualify — soften certainty markers, allow tentative phrasing."),
    ("claim_certainty", "preserve", "Claim certainty: preserve — keep certainty roughly where the original placed it."),
    ("claim_certainty", "strengthen", "Claim certainty: strengthen — remove unnecessary hedges, but do not add superlatives."),
    ("claim_certainty", "reduce", "Claim certainty: reduce — convert assertions into observations or qualified statements."),
    ("expression_budget", "none", "Expression budget: allow no strongest expressions (no superlatives, no maximalist framings)."),
    ("expression_budget", "one", "Expression budget: allow at most one strongest expression in the passage."),
    ("expression_budget", "few", "Expression budget: allow a few strongest expressions, but only where evidence is shown nearby."),
    ("expression_budget", "preserve", "Expression budget: preserve the original count of strongest expressions."),
    ("superlative_ceiling", "none", "Superlative ceiling: no superlatives anywhere."),
    ("superlative_ceiling", "one_per_section", "Superlative ceiling: one superlative per section maximum."),
    ("superlative_ceiling", "preserve_if_evidence", "Superlative ceiling: preserve a superlative only if it is evidence-bearing."),
    ("binary_contrast", "avoid", "Binary contrasts: avoid X-vs-Y framings entirely."),
    ("binary_contrast", "sparingly", "Binary contrasts: allow at most one X-vs-Y framing in the passage."),
    ("binary_contrast", "preserve_if_central", "Binary contrasts: preserve a binary framing only when it is the central claim."),
    ("abstraction_level", "concrete", "Abstraction level: concrete — prefer specific names, numbers, and events over abstract nouns."),
    ("abstraction_level", "balanced", "Abstraction level: balanced — alternate between concrete examples and conceptual framing."),
    ("abstraction_level", "conceptual", "Abstraction level: conceptual — keep the passage in abstract / framing register."),
    ("rhythm_policy", "vary_openings", "Rhythm policy: vary sentence openings — do not start consecutive sentences with the same construction."),
    ("rhythm_policy", "break_mirrored", "Rhythm policy: break mirrored clauses — vary clause lengths and shapes."),
    ("rhythm_policy", "preserve_cadence", "Rhythm policy: preserve the original cadence and clause shape."),
]
# Target lines of a profile.
LINE_RHYTHM = "Vary sentence length rhythm — avoid adjacent sentences of similar length"
LINE_VARIETY = "Increase rhetorical variety — mix claims, evidence, pivots, and elaboration"
LINE_DECAY = "Maintain structural variety throughout — avoid entropy decay toward the end"
POSITIVE_RHYTHM = "Vary sentence lengths — alternate short (5-8 words) and long (20-35 words)"
POSITIVE_VARIETY = "Mix rhetorical structures — use questions, fragments, inversions, not just declaratives"
POSITIVE_DECAY = "Maintain structural variety throughout — don't let the writing flatten toward the end"

# Shapes of one opposition sentence.
OPPOSITION_SHAPES = {
    "not_about": r"^(.+?)\s+(?:is|are|was|were)\s+not\s+about\s+(.+?)(?:,\s*)?(?:but\s+(?:it\s+)?(?:is\s+)?about|[,;:—-]\s*(?:(?:it'?s|it is|this is|that is)\s+)?about)\s+(.+?)[.!?]?$",
    "not_merely_about": r"^(?:it|this|that)\s+is\s+not\s+(?:simply|just|only|merely)\s+about\s+(.+?)\s+but\s+about\s+(.+?)[.!?]?$",
    "not_only_can": r"^not\s+only\s+can\s+([A-Z][\w-]*)\s+(.+?),\s+but\s+(?:it|they|he|she|we|that)\s+can\s+also\s+(.+?)[.!?]?$",
    "nuanced": r"^but\s+the\s+real\s+opportunity\s+is\s+much\s+more\s+nuanced:\s*(.+?)[.!?]?$",
    "one_and_other": r"^on\s+(?:the\s+)?one\s+hand,\s*(.+?)[.;]\s*on\s+the\s+other\s+hand,\s*(.+?)[.!?]?$",
    "one_hand": r"^on\s+(?:the\s+)?one\s+hand,\s*(.+?)[.!?]?$",
    "other_hand": r"^on\s+the\s+other\s+hand,\s*(.+?)[.!?]?$",
}

# Shapes of two neighbouring sentences.
OPPOSITION_PAIRS = {
    "glance": (r"^at first glance,\s*(.+?)[.!?]?$", r"^but\s+the\s+real\s+opportunity\s+is\s+(?:much\s+more\s+nuanced:\s*)?(.+?)[.!?]?$"),
    "hands": (r"^on\s+(?:the\s+)?one\s+hand,\s*(.+?)[.!?]?$", r"^on\s+the\s+other\s+hand,\s*(.+?)[.!?]?$"),
    "about": (r"^(.+?)\s+(?:is|are|was|were)\s+not\s+about\s+(.+?)[.!?]?$", r"^(?:it|this|that)\s+is\s+about\s+(.+?)[.!?]?$"),
}

# Notes on the risk of a rewrite.
RISK_NOTES = {
    "neg": "Negation markers dropped relative to the source — the factual boundary of the claim may have shifted.",
    "sure": "Strong certainty language increased versus the original; verify claim scope still matches.",
    "loud": "Strong intensifiers appeared while the expression budget was set to none.",
    "thin": "The rewrite is much shorter — check that supporting nuance was not removed.",
    "blank": "No original passage to compare.",
    "none": "No automatic red flags on negation, certainty spikes, or length collapse.",
}
# Words of the summary of a change.
CHANGE_WORDS = {
    "down": "density ↓", "up": "density ↑", "level": "density ~same", "fewer": " fewer pattern hits", "more": " more pattern hits",
    "same": "pattern hits ~same", "variety": "more device variety", "less": "less device variety",
}

# Rewrites that depend on a setting or on a sentence's place.
EMPHATIC_RULE = (r"\bimportant\b", "important and well-supported")
BUDGET_NONE = r"\btruly\b|\bstrongest\b|\bsharpest\b"
EVIDENCE_RULES = [
    (r"^In strong writing,\s*", "Strong writing works best when "),
    (r"^While traditional approaches relied heavily on manual processes,\s*", "Compared with manual processes, "),
]
RHYTHM_RULES = [(1, r"^This\b", "That focus"), (2, r"^Save\b", "Reserve")]
