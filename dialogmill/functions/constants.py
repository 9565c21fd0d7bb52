"""Word lists, thresholds and templates.

Fixed values: results depend on them, so they are given as they must be.
"""

# --- fixed values: answers -------------------------------------------------------------------
FIRST_PERSON = ["i", "i'm", "i’ve", "i'd", "i'll", "my", "mine", "we", "we've", "our", "ours"]
LIVE_FIRST_PERSON = ["i", "i'm", "i've", "my", "we", "our"]
AI_DISCLAIMERS = ["as an ai", "i cannot", "i can't help with that", "language model"]
MIN_WORDS, MAX_WORDS = 45, 140
FIRST_PERSON_PREFIX = "I would explain it this way: "
SHORT_ANSWER_EXTENSION = "I would keep the answer concrete by mentioning the tradeoffs, the production impact, and how I validated the result."
EMPTY_ANSWER = ("I would answer ", " by focusing on the practical tradeoffs, the implementation details, and the outcome I delivered.")

AI_KEYWORDS = ["agent", "ai", "automation", "chatgpt", "claude", "copilot", "embedding", "evaluation", "fine-tune", "fine tuning", "gpu", "hallucination", "inference", "llm", "machine learning", "ml", "mlops", "model", "prompt", "rag", "retrieval", "token", "training", "transformer", "vector"]
BEHAVIORAL_KEYWORDS = ["behavioral", "collaboration", "communication", "conflict", "deadline", "failure", "feedback", "leader", "leadership", "manager", "mentor", "mistake", "pressure", "priority", "stakeholder", "team", "teammate", "tradeoff"]
SYSTEM_KEYWORDS = ["api", "architecture", "backend", "cache", "database", "distributed", "grpc", "kubernetes", "latency", "microservice", "queue", "replication", "rest", "scalability", "system design", "throughput"]
SECURITY_KEYWORDS = ["auth", "oauth", "jwt", "security", "xss", "csrf", "owasp", "encryption", "secret"]
DATABASE_KEYWORDS = ["database", "sql", "index", "query", "replication", "postgres", "mysql", "redis"]
BACKEND_KEYWORDS = ["api", "rest", "grpc", "http", "service", "backend", "endpoint"]
SERVING_KEYWORDS = ["deployment", "gpu", "training", "serving", "latency", "inference"]

# --- fixed values: imported question-answer pairs ----------------------------------------------
IMPORT_AI_KEYWORDS = [*AI_KEYWORDS, "artifact", "ajan", "cikarim", "çıkarım", "egitim", "eğitim", "gomme", "gömme", "ince ayar", "makine ogrenmesi", "makine öğrenmesi", "vektor", "vektör", "yapay zeka"]
IMPORT_BEHAVIORAL_KEYWORDS = [*BEHAVIORAL_KEYWORDS, "catisma", "çatışma", "davranissal", "davranışsal", "geri bildirim", "iletisim", "iletişim", "liderlik", "paydas", "paydaş", "takim", "takım"]
IMPORT_SYSTEM_KEYWORDS = [*SYSTEM_KEYWORDS, "dagitik", "dağıtık", "gecikme", "mimari", "olceklenebilirlik", "ölçeklenebilirlik", "onbellek", "sistem tasarimi", "sistem tasarımı", "veritabani", "veritabanı"]
IMPORT_SECURITY_KEYWORDS = ["auth", "oauth", "jwt", "security", "xss", "csrf"]
IMPORT_DATABASE_KEYWORDS = ["database", "sql", "index", "query", "replication"]
IMPORT_API_KEYWORDS = ["api", "rest", "grpc"]
IMPORT_DESIGN_KEYWORDS = ["system design", "architecture", "distributed", "scalability", "cache"]

# --- fixed values: web corpus ------------------------------------------------------------------
TECH_HINTS = ["system", "design", "latency", "throughput", "cache", "distributed", "database", "kubernetes", "docker", "microservice", "architecture", "interview", "algorithm", "complexity", "nlp", "llm", "transformer", "embedding", "vector", "retrieval", "rag", "prompt", "python", "typescript", "backend", "observability", "security", "mlops"]
QUESTION_HINTS = ["what", "how", "why", "when", "difference", "explain", "design", "interview", "tradeoff", "latency"]
EN_STOPWORDS = ["the", "and", "is", "are", "with", "for", "that", "this", "you", "your", "how"]
TR_STOPWORDS = ["ve", "ile", "icin", "bu", "bir", "olarak", "nasil", "neden", "hangi", "kadar"]
TR_LETTERS = "ğüşöçıİĞÜŞÖÇ"
NOISE_MARKERS = ["cookie", "subscribe", "sign in", "log in", "privacy policy", "accept all", "terms of service", "advertisement", "javascript is disabled"]
GLOSSARY_STOPWORDS = ["the", "and", "that", "this", "with", "from", "into", "about", "your", "have", "what", "when", "where", "which", "there", "while", "without", "using", "used", "example", "interview", "question"]
CATEGORY_WEIGHTS = [10, 9, 8, 8, 5, 5, 7, 5, 15, 18, 6, 4]

# --- fixed values: retrieval -------------------------------------------------------------------
SOURCE_WEIGHT = {"job_desc": 0.45, "cv": 0.35, "github": 0.3, "linkedin": 0.25, "note": 0.2, "knowledge_base": 0.33, "web_corpus": 0.31, "glossary": 0.4}
INTENT_MULTIPLIER = {
    "candidate_specific": {"job_desc": 1.15, "cv": 1.3, "github": 1.15, "linkedin": 1.1, "note": 1.05, "knowledge_base": 0.78, "web_corpus": 0.82, "glossary": 0.88},
    "technical_general": {"job_desc": 0.92, "cv": 0.62, "github": 0.95, "linkedin": 0.58, "note": 0.88, "knowledge_base": 1.35, "web_corpus": 1.25, "glossary": 1.55},
    "mixed": {"job_desc": 1.08, "cv": 1.0, "github": 1.05, "linkedin": 0.95, "note": 1.0, "knowledge_base": 1.15, "web_corpus": 1.1, "glossary": 1.2},
}
UNKNOWN_WEIGHT, LEXICAL_WEIGHT, FRESHNESS_WEIGHT, FRESH_DAYS = 0.1, 1.2, 0.08, 90
MAX_CHUNK_CHARS, MIN_CHUNK_CHARS, MAX_CHUNKS = 460, 24, 200

# --- fixed values: question intent, one pattern a line -------------------------------------------
DAILY_MARKERS = [
    r"(how (was|is|has) your day|how your day went|how did your day go)",
    r"(how do you spend your day|walk me through your day|describe your day)",
    r"(typical day|a day in your life|daily routine|workday)",
    r"(gunun nasil gecti|gunun nasil geciyor|bir gunun nasil gecer)",
]
PERSONAL_MARKERS = [
    r"(tell me about yourself|walk me through your|your background|your experience)",
    r"tell me about your",
    r"(in your experience|you worked on|you built|you led|you shipped)",
    r"(my project|my experience|my role|our project)",
    r"(resume|cv|linkedin|github)",
]
GENERAL_MARKERS = [
    r"(what is|what are|explain|define|difference between|compare)",
    r"(how does|how do|why does|when should)",
    r"(nlp|transformer|bert|llm|embedding|tokenization)",
    r"(system design|microservice|kubernetes|database|latency|throughput)",
    r"(algorithm|complexity|big o|thread|concurrency|cache)",
]
