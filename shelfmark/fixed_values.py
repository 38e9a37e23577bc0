"""Fixed values.

Word lists, selectors, sentinels and limits that decide results. They have to
be exactly these for the output to be right, so they are kept here as plain
text, together and in their natural order. Everything that reads them also
takes them as a parameter.
"""

# --- fixed values: sentinels of the product record -------------------------
UNKNOWN_NAME = "Unknown Product"
MISSING = "N/A"
NO_DESCRIPTION = "No description available"
NO_PRICE = ("0", "00")
INVALID_NAMES = ["", "Unknown Product", "None", "none", "null", "N/A"]
INVALID_PRICES = ["", "0", "None", "none"]
NOT_DONE_NAMES = ["", "none", "null", "n/a", "na"]

# --- fixed values: limits ---------------------------------------------------
NAME_LENGTH = 80
REVIEW_LENGTH = 50
SUMMARY_LENGTH = 100
EMPTY_PAGE_STREAK = 3
COOLDOWN_SECONDS = 180
MAX_RETRIES = 2
API_RETRIES = 3
BACKOFF_SECONDS = 15
PRODUCT_LINK = "-p-"
LIST_HEADER = "# One product URL per line. Lines starting with # are ignored."

# --- fixed values: page triage ----------------------------------------------
URL_BLOCK_PATTERNS = [
    "captcha",
    "challenge",
    "verify",
    "security-check",
    "cf-challenge",
    "turnstile",
]
LISTING_BLOCK_PATTERNS = ["captcha", "challenge", "verify", "risk"]
TEXT_BLOCK_WORDS = [
    "verify you are human",
    "verify your identity",
    "security check",
    "slide to complete",
    "drag the puzzle",
    "i am human",
    "i'm not a robot",
    "are you human",
    "robot verification",
    "please verify",
    "security verification",
    "turnstile",
]
TEXT_BLOCK_WORDS_ALT = [
    "captcha",
    "verify you are human",
    "security check",
    "slide to complete",
    "drag the puzzle",
    "i am human",
    "robot",
    "access denied",
    "please verify",
]
PRODUCT_MARKERS = [
    '"product"',
    "productintro",
    "product-intro",
    "add to bag",
    "add to cart",
    "sku",
    "price",
    "product-detail",
    "productMainPriceId",
    "fsp-element",
    "productPrice",
]
PRODUCT_MARKER_MINIMUM = 2
LOGIN_PATH = "/user/auth/login"

# --- fixed values: markup selectors -----------------------------------------
# (tag, attribute, test, value); "is" compares a class token, the whole class
# attribute or the plain attribute, "like" searches a case-insensitive pattern.
NAME_SELECTORS = [
    ("span", "class", "is", "fsp-element"),
    ("h1", "class", "is", "fsp-element"),
    ("h1", "class", "like", "product.*title"),
    ("h1", None, None, None),
]
PRICE_SELECTORS = [
    ("div", "id", "is", "productMainPriceId"),
    ("div", "class", "is", "productPrice__main"),
    ("span", "class", "like", "price.*current"),
    ("div", "class", "like", "price"),
]
OLD_PRICE_SELECTORS = [
    ("p", "class", "is", "productEstimatedTagNewRetail__retail"),
    ("div", "class", "is", "productDiscountInfo__retail"),
    ("span", "class", "like", "price.*original"),
    ("del", None, None, None),
]
DISCOUNT_SELECTORS = [
    ("div", "class", "is", "productEstimatedTagNew__percent"),
    ("div", "class", "is", "productDiscountPercent"),
    ("span", "class", "like", "discount"),
    ("span", "class", "like", "percent"),
]
DESCRIPTION_SELECTORS = [
    ("div", "class", "is", "product-intro__attr-list-text"),
    ("div", "class", "is", "product-intro__attr-des"),
    ("div", "class", "is", "product-intro__attr-list-text product-intro__attr-list-textMargin"),
    ("div", "class", "is", "product-intro__attr-wrap"),
    ("div", "class", "like", "description"),
    ("p", "class", "like", "description"),
]
SHIPPING_SELECTORS = [
    ("div", "class", "is", "product-intro__size-radio"),
    ("div", "class", "like", "shipping.*radio"),
    ("div", "class", "like", "envio"),
]
SIZE_CLASS = "product-intro__size-radio"
SOLD_OUT = "soldout"
SHIPPING_SOLD_OUT = "_soldout"
NATIONAL_LABEL = "Envio Nacional"
INTERNATIONAL_LABEL = "International"
ATTRIBUTE_BLOCK_NAME = "ProductIntroDescription"
ATTRIBUTE_BLOCK_CLASS = "common-entry__container"
SPEC_ANCHOR = 'class="common-entry__content"'
SPEC_BEFORE = 100
SPEC_WINDOW = 50000
SPEC_LABEL_BELOW = 50
SPEC_LABEL_ABOVE = 2
SPEC_LOOKAHEAD = 4
SPEC_VALUE_STOP = 100
SPEC_NOISE = [
    "Classificação",
    "Itens",
    "Seguidores",
    "pago",
    "seguido",
    "está navegando",
    "Vendas",
    "Avaliações",
]

# --- fixed values: API error words ------------------------------------------
QUOTA_WORDS = [
    "429",
    "resource_exhausted",
    "quota",
    "too many requests",
    "rate limit",
    "ratelimitexceeded",
    "usage limit",
    "usage_limit_exceeded",
    "daily limit",
    "per-minute",
    "per_minute",
    "per-day",
    "per_day",
    "insufficient_quota",
    "billing",
    "token limit",
    "capacity exhausted",
]
PERMANENT_WORDS = [
    "not_found",
    "invalid_argument",
    "permission_denied",
    "unauthenticated",
    "unauthorized",
    "forbidden",
    "unimplemented",
    "failed_precondition",
    "api_key_invalid",
    "invalid api key",
    "api key not valid",
    "bad request",
    "method not allowed",
    "unprocessable entity",
]
RETRYABLE_WORDS = [
    "503",
    "429",
    "unavailable",
    "temporary",
    "temporarily",
    "service unavailable",
    "high demand",
    "rate",
    "quota",
    "limit",
    "resource_exhausted",
    "too many requests",
    "timeout",
    "timed out",
    "connection",
    "deadline exceeded",
    "internal",
    "server error",
    "bad gateway",
    "gateway timeout",
]
PERMANENT_CODES = [400, 401, 403, 404, 405, 422]
PERMANENT_LABELS = [
    "NOT_FOUND",
    "INVALID_ARGUMENT",
    "PERMISSION_DENIED",
    "UNAUTHENTICATED",
    "UNIMPLEMENTED",
    "FAILED_PRECONDITION",
]
# label -> alternatives; each alternative lists words that must all be present
QUOTA_LABELS = [
    ("RESOURCE_EXHAUSTED", [["resource_exhausted"]]),
    ("BILLING_QUOTA_EXCEEDED", [["billing"]]),
    ("DAILY_QUOTA_EXCEEDED", [["daily", "limit"], ["daily", "quota"]]),
    ("PER_MINUTE_QUOTA_EXCEEDED", [["per-minute"], ["per_minute"]]),
    ("PER_DAY_QUOTA_EXCEEDED", [["per-day"], ["per_day"]]),
    ("RATE_LIMIT_EXCEEDED", [["rate limit"], ["ratelimitexceeded"]]),
    ("TOO_MANY_REQUESTS", [["too many requests"]]),
    ("USAGE_LIMIT_EXCEEDED", [["usage limit"], ["usage_limit_exceeded"]]),
    ("TOKEN_LIMIT_EXCEEDED", [["token limit"]]),
    ("CAPACITY_EXHAUSTED", [["capacity"]]),
    ("QUOTA_EXCEEDED", [["quota"]]),
]
QUOTA_DEFAULT_LABEL = "QUOTA_EXHAUSTED"

# --- fixed values: operational log ------------------------------------------
LEVEL_BY_COLOUR = [("91", "ERROR"), ("93", "WARNING"), ("92", "INFO")]

# --- fixed values: product card ----------------------------------------------
CARD_TEMPLATE = (
    "Product Name: %s\n\nPrice: From R$%s to R$%s (%s)\n\n"
    "Description: %s\n\n🛒 %s\n👉 %s"
)

# --- fixed values: categories, id / name / path on the site -------------------
CATEGORIES = [
    (1, "New In", "/recommend/New-In-sc-10050082658.html"),
    (2, "Sale", "/sale/All-Sale-sc-0051884505.html"),
    (3, "Women Clothing", "/Women-Clothing-c-2030.html"),
    (4, "Beachwear", "/RecommendSelection/Beachwear-sc-017706887.html"),
    (5, "Kids", "/RecommendSelection/Kids-sc-017185550.html"),
    (6, "Curve", "/RecommendSelection/Curve-sc-017172964.html"),
    (7, "Men Clothing", "/RecommendSelection/Men-Clothing-sc-017172963.html"),
    (8, "Shoes", "/RecommendSelection/Shoes-sc-017172966.html"),
    (9, "Underwear & Sleepwear", "/RecommendSelection/Underwear-Sleepwear-sc-017172965.html"),
    (10, "Home & Living", "/RecommendSelection/Home-Kitchen-sc-017185546.html"),
    (11, "Jewelry & Accessories", "/RecommendSelection/Jewelry-Accessories-sc-017291431.html"),
    (12, "Beauty & Health", "/RecommendSelection/Beauty-Health-sc-017172970.html"),
    (13, "Baby & Maternity", "/RecommendSelection/Baby-Maternity-sc-017172967.html"),
    (14, "Bags & Luggage", "/RecommendSelection/Bags-Luggage-sc-017174546.html"),
    (15, "Sports & Outdoors", "/RecommendSelection/Sports-Outdoors-sc-017185553.html"),
    (16, "Home Textiles", "/RecommendSelection/Home-Textile-sc-017172972.html"),
    (17, "Cell Phones & Accessories", "/RecommendSelection/Cell-Phones-Accessories-sc-017706910.html"),
    (18, "Electronics", "/RecommendSelection/Electronics-sc-017706908.html"),
    (19, "Toys & Games", "/RecommendSelection/Toys-Games-sc-017172978.html"),
    (20, "Tools & Home Improvement", "/RecommendSelection/Tools-Home-Improvement-sc-017185547.html"),
    (21, "Office & School Supplies", "/RecommendSelection/Office-School-Supplies-sc-017185552.html"),
    (22, "Pet Supplies", "/RecommendSelection/Pet-Supplies-sc-017172974.html"),
    (23, "Appliances", "/RecommendSelection/Appliances-sc-017172977.html"),
    (24, "Automotive", "/RecommendSelection/Automotive-sc-017172975.html"),
    (25, "Books & Magazine", "/RecommendSelection/Books-Magazines-sc-0175086797.html"),
    (26, "Food & Beverages", "/RecommendSelection/Food-Beverages-sc-0175086791.html"),
]
