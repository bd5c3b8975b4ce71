"""Fixed values and defaults.

Values under "FIXED VALUES" must equal the reference behaviour for results to
match; they are stated plainly and in their natural order. Everything else
(our own prompt wording, binding choices) is ours.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference's behaviour)
# ---------------------------------------------------------------------------

# Null marker written by cleaning and skipped by text/prompt building.
NOT_AVAILABLE = "Not available"

# Columns filled with NOT_AVAILABLE by cleaning, in this order.
FILL_COLUMNS = [
    "Category",
    "Selling Price",
    "Model Number",
    "About Product",
    "Product Specification",
    "Technical Details",
    "Shipping Weight",
    "Product Dimensions",
    "Variants",
]

# Columns dropped by cleaning when present.
DROP_COLUMNS = ["Upc Ean Code"]

# Strings the CSV loader reads as null (pandas read_csv defaults).
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Label order used when building the combined product text.
TEXT_FIELDS = [
    ("Product Name", "Product Name"),
    ("Category", "Category"),
    ("Price", "Selling Price"),
    ("Model", "Model Number"),
    ("About", "About Product"),
]
TEXT_SEPARATOR = " | "

# Context block details: (label, metadata column), in this order.
CONTEXT_DETAILS = [
    ("Shipping Weight", "shipping_weight"),
    ("Product Dimensions", "product_dimensions"),
    ("Product Specification", "product_specification"),
    ("Technical Details", "technical_details"),
    ("Product URL", "product_url"),
    ("Image URL", "image_url"),
]
CONTEXT_VALUE_MAX = 200          # longer detail values are cut to this + "..."
PROMPT_MAX_CHARS = 6000          # prompt builder budget
COMPARISON_GROUP_ITEMS = 3       # items per group in the comparison prompt

# Generation defaults and stop strings of the retrieval answer step.
GEN_MAX_TOKENS = 300
GEN_TEMPERATURE = 0.1
GEN_STOP_SEQUENCES = ["\nUser question:", "\nQ:"]
NO_RESULTS_MESSAGE = "I'm sorry, but I couldn't find any relevant products for your query."
GENERATION_ERROR_MESSAGE = (
    "I apologize, but I encountered an error while generating a response. Please try again."
)
DEFAULT_QUERY_TEXT = "Describe these products"

# Rule-based answers used when no generator is configured.
FALLBACK_SEARCH_RESULTS = (
    "Based on the search results, I found several relevant products that match your query. "
    "Please review the products listed above for detailed information including prices, "
    "specifications, and purchasing links."
)
FALLBACK_PRODUCT = (
    "Here are some product recommendations based on your search. "
    "Each result includes product details, pricing, and direct links to purchase."
)
FALLBACK_OTHER = (
    "I found some relevant results for your query. "
    "Please check the search results above for more information."
)

# Field-question indicator phrases.
FIELD_QUERY_INDICATORS = [
    "what is the", "what's the", "tell me the", "show me the",
    "how much", "what size", "what color", "what brand",
    "price", "cost", "dimensions", "weight", "model",
]

# Request limits.
K_MIN, K_MAX = 1, 50

# Token cost estimate: price per 1000 whitespace words.
COST_PER_1K_TOKENS = 0.0015
COST_PER_1K_INPUT = 0.0015
COST_PER_1K_OUTPUT = 0.002

# Fusion and loss constants.
HYBRID_WEIGHTS = (0.6, 0.4)
MULTIMODAL_WEIGHTS = (0.5, 0.5)
PRODUCT_WEIGHTS = (0.7, 0.3)
CONTRASTIVE_TEMPERATURE = 0.07
CATEGORY_LOSS_ALPHA = 0.1
FUZZY_THRESHOLD = 0.8
TRAIN_RATIO = 0.8
MIN_TRAIN_TEXT_CHARS = 10
BAD_IMAGE_MARKER = "transparent-pixel"

# Index defaults.
IVF_NLIST = 100
IVF_NPROBE = 10
EVAL_K_VALUES = [1, 5, 10, 20]

# BLEU: 4-gram uniform weights, smoothing method 4 constant.
BLEU_MAX_N = 4
BLEU_SMOOTH_K = 5

# Catalogue demo search.
CATALOGUE_MAX_RESULTS = 5
