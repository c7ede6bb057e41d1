"""Fixed values that results depend on."""

# Words left out of queries.
STOPWORDS = (
    "a an the and or of for to in on at by with from into as is are was were be been being do does did how what which when where why who "
    "i me my we you your it its this that these those can could should would will make makes made use uses used using get gets getting "
    "want need there here if then than so but not no yes please help between"
).split()

# Verbs that shape a query without being its subject.
INTENTS = (
    "spawn despawn add insert remove delete create make get set apply update build load open close play run start stop use attach "
    "register send emit read write enable disable toggle bind handle process turn communicate communication communicating compare difference"
).split()

# Kinds that define a type, and kinds that are members of one.
DEFINITIONS = ("struct", "enum", "trait", "fn", "type", "primitive")
MEMBERS = ("method", "field", "variant", "associatedconstant", "associatedtype")

# Weights by kind; else by source; else OTHER_WEIGHT.
KIND_WEIGHT = {
    "field": 0.45, "book": 0.7, "tutorial": 0.7, "migration_guide": 0.7, "migration_entry": 0.65, "release_notes": 0.6, "faq": 0.55,
    "guide": 0.5, "doc": 0.35, "news": 0.12, "foundation": 0.0, "donate": 0.0, "sponsorship": 0.0,
}
SOURCE_WEIGHT = {"rustdoc": 1.0, "examples": 0.9, "learn-examples": 0.85, "website": 1.0, "meta": 1.0}
OTHER_WEIGHT = 0.4

# Boosts of the text index's fields, BM25 constants, caps of the postings, width of the pool.
FIELD_BOOST = {"name": 4.0, "signature": 2.0, "docs": 1.0}
K1, B = 1.2, 0.75
SYMBOL_CAP, TOKEN_CAP, POOL = 60, 1000, 2000
