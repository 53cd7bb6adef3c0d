"""Fixed values that must equal the reference's so that results agree.

They are listed plainly, in the reference's natural order.
"""

# The mention-classification label vocabulary, id order 0..13.
KBASE_LABELS = [
    "plasmid",
    "organism host",
    "promoter",
    "genome engineering",
    "cloning method",
    "reporter",
    "regulator",
    "antibiotic marker",
    "genetic screen",
    "RBS",
    "counter selection",
    "terminator",
    "DNA transfer",
    "operator",
]

# Label excluded from mention records and from curated scoring.
NOT_RELEVANT = "not relevant"

# The class used for an unmatched or rejected item.
NONE_LABEL = "none"

# The label whose single value names a paper's host species.
HOST_LABEL = "organism host"

# Label rewrites applied after the plural rule.
LABEL_ALIASES = {
    "rbs (ribosome binding site)": "rbs",
    "counter selection marker": "counter selection",
}

# The one label exempt from the trailing-"s" plural rule.
PLURAL_EXEMPT = ["rbs"]

# Prefixes (compared in lower case) that mark a refusal, not an entity.
REFUSAL_PREFIXES = [
    "not specified",
    "not mentioned",
    "none mentioned",
    "not explicitly mentioned",
    "the paper does not mention",
    "the paper does not explicitly mention",
    "the paper does not specify",
    "the authors did not mention",
]

# Species synonyms. Each canonical name has case-insensitive
# variants and exact sentences that are rewritten to it.
SPECIES_SYNONYMS = [
    ("Escherichia coli",
     ["e. coli", "e. coli.", "e.coli", "coli", "escherichia coli", "escherichia coli (e. coli)"],
     ["The paper uses Escherichia coli as the organism host for the optogenetic toolkit and antibiotic resistance genes.",
      "The paper mentions the use of Escherichia coli as the host organism for cloning and transformation.",
      "The paper uses Escherichia coli as the organism host for expressing the genetic circuits.",
      "The paper uses E. coli as the host organism for the phage Mu transposition experiments.",
      "The paper mentions the use of E. coli as an organism host for the genetic tools and techniques described. E. coli is a common bacterium that is often used as a host for genetic engineering due to its ability to easily take up and replicate plasmids.",
      "The paper mentions the use of E. coli as a host organism for genetic engineering and plasmid cloning.",
      "Cre recombinase is expressed in E. coli cells."]),
    ("Escherichia coli BL21",
     ["e. coli bl21", "escherichia coli bl21"],
     ["The organism host used in this study is Escherichia coli (E. coli) strain BL21."]),
    ("Acidithiobacillus ferrooxidans",
     ["acidithiobacillus ferrooxidans", "a. ferrooxidans"],
     []),
    ("Bacillus subtilis",
     ["bacillus subtilis", "b. subtilis", "bacillus", "acillus subtilis"],
     ["The paper uses B. subtilis as an organism host for the riboswitch reporter system and for constructing strains heterologously expressing P. megaterium metE and metH."]),
    ("Saccharomyces cerevisiae",
     ["saccharomyces cerevisiae", "s. cerevisiae"],
     ["The authors used the yeast Saccharomyces cerevisiae as the organism host to express the protein components."]),
    ("Kluyveromyces lactis",
     ["kluyveromyces lactis"],
     ["The paper mentions that the yeast Kluyveromyces lactis contains killer DNA plasmids."]),
]

# Generation budgets per task (new tokens).
MAX_NEW_TOKENS = {"entity_type": 40, "entity_and_entity_type": 2000}

# Context limits (input + output tokens) by model family or variant.
CONTEXT_LIMITS = [
    ("family", "Falcon", 2048),
    ("variant", "mpt-7b-chat", 2048),
    ("family", "LLaMA-2", 4096),
    ("family", "Solar", 4096),
    ("variant", "mpt-30b-chat", 8192),
    ("variant", "Mistral-7B-Instruct-v0.2", 8192),
    ("family", "LLaMA-3", 8192),
    ("variant", "Mixtral-8x7B-Instruct-v0.1", 32768),
]

# Report layout markers.
REPORT_ROWS_START = "*" * 68
REPORT_ROWS_END = "#" * 68
REPORT_RULE = "-" * 68
REPORT_METRICS_END = "=" * 68
# Header line by dataset, and configuration blocks.
REPORT_DATASET_LINES = {
    "kegg": ">> KEGG data type: {}",
    "indra": ">> Number of INDRA classes: {}",
    "kbase": ">> Number of KBase classes: {}",
}
REPORT_CONFIG_BLOCKS = [
    (">> Model configuration:", "model_config"),
    (">> Generation configuration:", "generation_config"),
]

# Shuffle seed and split fraction.
DEFAULT_SEED = 42
TEST_FRACTION = 0.1

# Entity-list alignment cap and pad token.
ALIGN_CAP = 10
ALIGN_PAD = "NONE"

# Label-mask replacement and default pad id.
LOSS_IGNORE_ID = -100
PAD_ID = 0
