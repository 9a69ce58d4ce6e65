"""Word lists, labels, replies and generator domains.

Everything in this file must stay as it is for results to be comparable with
existing chat logs and corpora. Nothing here is computed.
"""

from __future__ import annotations

# --- Text preparation -------------------------------------------------------

# Contractions, applied in this order.
CONTRACTIONS = [
    ("won't", "will not"),
    ("can't", "cannot"),
    ("n't", " not"),
    ("'re", " are"),
    ("'s", " is"),
    ("'d", " would"),
    ("'ll", " will"),
    ("'t", " not"),
    ("'ve", " have"),
    ("'m", " am"),
]

# Verb forms the Treebank tokenizer splits in two.
FUSED_FORMS = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")]

# Domain terms that pass untouched, tested before stop words.
DOMAIN_TERMS = """
savings current salary fixed deposit fd rd recurring
transfer neft rtgs imps upi transaction balance
debit credit card pin cvv expiry limit
loan emi interest principal tenure maturity
cheque draft withdrawal overdraft standing instruction
otp password authentication verification kyc pan aadhaar
netbanking mobilebanking app login logout username
""".split()

# The public English stop-word list (entries with an apostrophe
# cannot occur after cleaning and are left out), then the extra words.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven
isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split()
EXTRA_STOP_WORDS = (
    "please could would also may might shall should hello hi hey thanks thank dear".split()
)
STOP_WORDS = ENGLISH_STOP_WORDS + EXTRA_STOP_WORDS

# Noun endings and what they are detached to (public WordNet rules).
NOUN_ENDINGS = [
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
]

# A small default lemma table; pass your own, or build one with operators.lemmas.
LEMMAS = {
    "accounts": "account",
    "addresses": "address",
    "balances": "balance",
    "banks": "bank",
    "branches": "branch",
    "cards": "card",
    "charges": "charge",
    "documents": "document",
    "fees": "fee",
    "funds": "fund",
    "loans": "loan",
    "payments": "payment",
    "photographs": "photograph",
    "purchases": "purchase",
    "queries": "query",
    "statements": "statement",
    "transactions": "transaction",
    "transfers": "transfer",
    "types": "type",
}

# Text columns prepared per bulk table.
TEXT_COLUMNS = {
    "user_details": [],
    "transaction_details": ["description"],
    "credit_cards": [],
    "loans": [],
    "complaints": ["description"],
    "fraud_reports": ["description"],
    "faqs": ["question", "answer"],
    "assistance": ["query"],
}

# Corpus sources in order: label, table, text column, canned reply
# (None: the processed answer column is the reply).
CORPUS_SOURCES = [
    ("faq", "faqs", "question", None),
    ("complaint", "complaints", "description", "Thank you for reporting this issue. Our team will look into it."),
    ("assistance", "assistance", "query", "Our customer support team will contact you shortly."),
    ("fraud", "fraud_reports", "description",
     "We take fraud seriously. Our security team will investigate this immediately."),
    ("transaction", "transaction_details", "description", "Your transaction details have been recorded."),
]

# --- Message understanding --------------------------------------------------

# Words tested as substrings, per intent.
ACCOUNT_TYPES = ["checking", "savings"]
DEFAULT_ACCOUNT = "checking"
ID_WORDS = ["id", "#", "number"]
GREETING_WORDS = ["hi", "hello", "hey", "good morning", "good afternoon"]
BALANCE_WORDS = ["balance", "how much", "money", "available"]
TRANSFER_WORDS = ["transfer", "send money", "payment", "pay"]
HISTORY_WORDS = ["transactions", "history", "recent", "spending", "purchases"]
AMOUNT_WORDS = ["dollars", "$"]
YES_WORDS = ["yes", "confirm", "proceed", "ok", "sure"]
NO_WORDS = ["no", "cancel", "stop", "don't"]

# The catalogue used when no intents file can be read.
DEFAULT_INTENTS = [
    ("greeting",
     ["Hi", "Hello", "Hey", "Good morning"],
     ["Hello! How can I assist you with your banking needs today?"]),
    ("balance_inquiry",
     ["What's my balance", "How much money do I have"],
     ["Your current balance is [AMOUNT]."]),
    ("transfer_money",
     ["I want to transfer money", "Send money"],
     ["I can help you transfer money."]),
    ("transaction_history",
     ["Show my transactions", "Transaction history"],
     ["Here are your recent transactions: [TRANSACTIONS]"]),
]
INTENT_TAGS = [tag for tag, _, _ in DEFAULT_INTENTS]

# --- Replies ----------------------------------------------------------------

# Reply texts; {..} marks a value filled per message.
GREETING_REPLIES = [
    "Hello! How can I assist you with your banking needs today?",
    "Hi there! How may I help you with your accounts?",
    "Welcome back! What would you like to do with your banking today?",
]
BALANCE_REPLIES = [
    "Your {account} account balance is ${balance}. Would you like to see your recent transactions?",
    "The balance in your {account} account is ${balance}. Is there anything else you'd like to know?",
    "You have ${balance} in your {account} account. Can I help you with anything else?",
]
REPLIES = {
    "no_balance": "I couldn't find information for your {account} account.",
    "recent": "Here are your recent transactions from your {account} account:{lines}",
    "no_recent": "I couldn't find any recent transactions for your {account} account.",
    "on_date": "Here are your transactions from {date} for your {account} account:{lines}",
    "none_on_date": "I couldn't find any transactions on {date} for your {account} account.",
    "in_range": "Here are your transactions from {start} to {end} for your {account} account:{lines}",
    "none_in_range": "I couldn't find any transactions between {start} and {end} for your {account} account.",
    "one": "Transaction {id}: {detail}",
    "no_such": "I couldn't find transaction {id} in your {account} account.",
    "confirm": "I'll set up a transfer of ${amount} from your {account} account to {recipient}'s account."
               " Would you like to proceed?",
    "ask_recipient": "I'll help you transfer ${amount}. Who would you like to send it to?",
    "ask_amount": "How much would you like to transfer to {recipient}?",
    "ask_details": "I can help you transfer money. Please provide the recipient's name and the amount"
                   " you'd like to transfer.",
    "switched_ask_recipient": "I'll help you transfer ${amount} from your {account} account."
                              " Who would you like to send it to?",
    "switched_ask_amount": "How much would you like to transfer to {recipient} from your {account} account?",
    "switched": "I've switched to your {account} account. How can I help you with this account?",
    "transferred": "I've transferred ${amount} from your {account} account to {recipient}'s account."
                   " The transaction has been completed successfully.",
    "cancelled": "I've cancelled that request. Is there something else I can help you with?",
    "fallback": "I'm not sure how to respond to that. Could you please rephrase your question?",
    "error": "I'm sorry, I encountered an error. Please try again.",
    "request_failed": "I apologize, but I'm having trouble processing your request at the moment.",
    "no_model": "I'm sorry, I'm having trouble processing your request right now.",
    "unknown_tag": "I'm not sure how to respond to that. Could you please rephrase?",
}
DEFAULT_RECIPIENT = "the recipient"

# Language selector to speech locale.
LOCALES = {
    "en": "en-US",
    "es": "es-ES",
    "fr": "fr-FR",
    "de": "de-DE",
    "it": "it-IT",
    "hi": "hi-IN",
    "ja": "ja-JP",
    "zh": "zh-CN",
}
DEFAULT_LOCALE = "en-US"

# --- Generator domains ------------------------------------------------------

# Categories of the generated tables.
TRANSACTION_TYPES = ["deposit", "withdrawal", "transfer", "payment", "refund"]
TRANSACTION_STATUSES = ["completed", "pending", "failed"]
CARD_TYPES = ["Visa", "MasterCard", "American Express", "Discover"]
CARD_STATUSES = ["active", "blocked", "expired"]
CARD_LIMITS = [50000, 100000, 200000, 500000]
LOAN_TYPES = ["Personal", "Home", "Auto", "Education", "Business"]
LOAN_STATUSES = ["approved", "pending", "rejected", "closed"]
LOAN_TERMS = [12, 24, 36, 48, 60, 120, 180, 240]
COMPLAINT_TYPES = [
    "Service Issues", "Technical Problems", "Account Issues", "Card Problems", "Loan Issues", "Staff Behavior",
]
COMPLAINT_PRIORITIES = ["Low", "Medium", "High", "Critical"]
COMPLAINT_STATUSES = ["Open", "In Progress", "Resolved", "Closed"]
FRAUD_TYPES = ["Unauthorized Transaction", "Identity Theft", "Phishing", "Card Skimming", "Account Takeover"]
FRAUD_STATUSES = ["Under Investigation", "Resolved", "Closed", "Pending"]
FAQ_CATEGORIES = ["Account", "Cards", "Loans", "Net Banking", "General"]
ASSISTANCE_TYPES = [
    "General Query", "Technical Support", "Account Support", "Product Information", "Service Request",
]
ASSISTANCE_STATUSES = ["Pending", "In Progress", "Resolved", "Closed"]
FAQ_PAIRS = [
    ("How do I open a new account?",
     "Visit our nearest branch with required documents or apply online through our website."),
    ("What documents are required for account opening?",
     "You need ID proof, address proof, PAN card, and passport-size photographs."),
    ("How do I check my account balance?",
     "You can check balance through net banking, mobile app, ATM, or by visiting branch."),
    ("What are the different types of accounts available?",
     "We offer savings, current, salary, and fixed deposit accounts."),
    ("How do I close my account?",
     "Submit an account closure form at your branch with required documents."),
]

# Our own vocabulary for generated names, addresses, jobs and free text.
FIRST_NAMES = "Ada Bela Carl Dana Emil Fay Gus Hana Ivo June Kai Lena Milo Nora Otto Pia".split()
LAST_NAMES = "Ash Birch Cole Dale Elm Ford Glen Hill Ives Jay Kerr Lake Moor Nash Oak Penn".split()
STREETS = "Mill Park Lake Hill Church Station Garden Bridge".split()
CITIES = "Northam Easton Southby Westford Midvale Lowick Highley Farrow".split()
JOBS = ["Teacher", "Nurse", "Engineer", "Farmer", "Baker", "Clerk", "Driver", "Painter"]
FILLER_WORDS = """
bank staff card letter online branch fee late missing wrong double charge slow answer phone screen
week today again never still open closed money sent received travel house office water paper green
""".split()
