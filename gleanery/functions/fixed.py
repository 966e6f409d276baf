"""Word lists, rule tables, patterns and weights that results depend on. They are data, in plain form; the rules that read them are elsewhere."""

# Words by tier of relevance.
HIGH = (
    "artificial intelligence", "ai", "machine learning", "ml", "deep learning", "neural network", "transformer", "llm", "large language model",
    "openai", "gpt", "chatgpt", "claude", "anthropic", "gemini", "bard", "copilot", "github copilot", "midjourney", "stable diffusion",
    "dall-e", "dalle", "hugging face", "langchain",
    "natural language processing", "nlp", "computer vision", "cv", "reinforcement learning", "rl", "generative ai", "gan",
    "diffusion model", "attention mechanism", "embedding", "fine-tuning", "prompt engineering", "rlhf",
    "ai assistant", "chatbot", "voice assistant", "ai model", "ai training", "ai inference", "ai safety", "ai alignment",
    "ai automated", "ai automation", "intelligent ai", "smart ai",
    "empathetic", "empathy", "emotion", "emotional", "emotional intelligence", "sentiment analysis", "affective computing", "behavioral", "behavior",
    "human-centered ai", "human-ai interaction", "social ai", "conversational ai", "dialogue", "personality", "persona", "tone", "communication",
    "user experience", "ux", "human-computer interaction", "hci", "psychology", "psychological", "social", "interpersonal",
    "人工知能", "機械学習", "深層学習", "ニューラルネットワーク", "自然言語処理", "チャットボット", "生成ai", "生成AI",
    "gpt-5", "gpt-4.5", "gpt-4o", "gemini 2.5", "claude 3.7", "llama 4", "agi", "artificial general intelligence", "sora", "superintelligence",
    "自主性ai", "汎用人工知能", "モデル発表", "新モデル", "次世代ai",
)
MEDIUM = (
    "algorithm", "data science", "analytics", "prediction", "classification", "clustering", "regression", "supervised learning", "unsupervised learning",
    "feature engineering", "model training", "inference", "deployment", "edge computing", "cloud ai", "ai chip", "gpu", "tensor",
    "pytorch", "tensorflow", "keras", "scikit-learn", "pandas", "jupyter", "notebook", "api", "sdk", "framework",
    "optimization", "hyperparameter", "cross-validation", "bias", "fairness", "explainable", "interpretable",
    "personalization", "recommendation", "cognitive", "simulation", "speech recognition", "text-to-speech", "multimodal", "reasoning",
    "knowledge graph", "semantic", "contextual", "adaptive", "interactive", "responsive", "intuitive", "assistance",
)
LOW = (
    "technology", "tech", "software", "programming", "coding", "development", "innovation", "digital", "data", "analytics",
    "platform", "service", "application", "system", "solution", "research", "science", "academic", "paper", "study",
    "startup", "company", "product", "business", "industry", "future", "trend", "advancement", "breakthrough", "discovery",
)
NEGATIVE = (
    "blockchain", "cryptocurrency", "bitcoin", "crypto", "nft", "web3", "defi", "metaverse", "gaming", "game", "sports",
    "entertainment", "music", "fashion", "food", "travel", "politics", "election", "weather", "finance", "banking",
    "real estate", "property", "automobile", "car", "tailscale", "ssh", "termius", "iphone setup", "mac setup",
    "network configuration", "mobile development", "ios development", "xcode", "swift", "objective-c", "terminal setup",
)
BLACKLIST = (
    "上履き", "キャリオット", "レビュー・口コミ", "商品レビュー", "製品テスト", "洗えて使いやすい", "実力を徹底検証", "使用感", "耐久性",
    "ファッション", "衣類", "アクセサリー", "美容", "化粧品", "スキンケア", "料理", "レシピ", "食材", "グルメ", "レストラン",
    "旅行", "観光地", "ホテル", "航空券", "宿泊予約", "スポーツ", "野球", "サッカー", "バスケ", "選手", "試合結果",
    "靴", "履物", "シューズ", "スニーカー", "ブーツ", "サンダル", "キッズ", "子供用品", "子供靴", "ホワイト", "15cm",
    "ファン", "扇風機", "ヒートプロテクタント", "スプレー", "ヘアケア",
    "週次レビュー", "PDCA", "振り返り", "レポート自動化", "業務改善", "KPI分析", "ダッシュボード", "業務プロセス", "ワークフロー改善",
    "PDCAサイクル", "PDCA高速化", "形骸化", "振り返りが３分", "自動レポート",
)
# Video channels by kind, and phrases that speak against a video.
SPECIALIST_CHANNELS, ADJACENT_CHANNELS, BUSINESS_CHANNELS = ("anthropic", "openai", "googledeepmind"), ("lexfridman",), ("ycombinator", "a16z", "sequoia", "lennys_podcast")
VIDEO_NEGATIVE = (
    "interview about", "personal journey", "lifestyle", "motivation", "general business", "fundraising tips", "networking", "career advice",
    "company culture", "leadership", "management", "hiring",
)
# Hosts and sources by standing, with the bonus of each.
OFFICIAL_HOSTS = ("openai.com", "google.com", "meta.com", "anthropic.com", "microsoft.com", "apple.com", "amazon.com", "nvidia.com")
REPUTABLE_HOSTS = ("techcrunch.com", "theverge.com", "wired.com", "venturebeat.com", "arstechnica.com", "engadget.com", "zdnet.com", "cnet.com")
ACADEMIC_MARKS = (".edu", ".ac.", "arxiv.org", "research.", "papers.")
QUALITY_HOSTS = ("spectrum.ieee.org", "research.google", "blog.google", "huggingface.co", "zenn.dev", "github.com", "medium.com")
OFFICIAL_SOURCES = ("openai_news", "anthropic_news", "google_research_blog", "google_gemini_blog", "huggingface_blog")
CURATED_SOURCES = ("the_decoder", "ai_newsletter_saravia", "semianalysis", "tldr_ai", "stratechery")
# Weighted keywords, phrases and patterns that exclude.
WEIGHTED = {
    "gpt": 1.0, "chatgpt": 1.0, "claude": 1.0, "gemini": 1.0, "llama": 1.0, "large language model": 1.0, "llm": 1.0, "transformer": 0.9,
    "openai": 1.0, "anthropic": 1.0, "deepmind": 0.9, "google ai": 0.9, "meta ai": 0.9, "microsoft ai": 0.8,
    "artificial intelligence": 0.9, "machine learning": 0.8, "deep learning": 0.8, "neural network": 0.7, "generative ai": 0.9, "multimodal": 0.8,
    "ai agent": 0.9, "automation": 0.6, "ai assistant": 0.8, "computer vision": 0.7, "natural language processing": 0.8,
}
EXCLUDING = (
    "electric vehicle", "ev battery", "battery recycling", "energy storage business", "charging infrastructure", "automotive industry", "redwood materials",
    "iphone setup", "smartphone config", "tailscale setup", "termius setup", "mobile configuration", "ssh connection", "ios configuration",
    "real estate", "cryptocurrency", "bitcoin", "ethereum", "nft", "defi", "blockchain trading", "investment fund", "financial product",
    "web3", "metaverse game", "social media", "entertainment", "virtual reality game", "gaming development",
    "network configuration", "vpn setup", "server management", "system administration", "infrastructure management",
    "computer hardware", "cpu specs", "gpu benchmarks", "memory upgrade", "storage solutions", "semiconductor manufacturing",
)
EXCLUDING_PATTERNS = (r"バッテリー.*リサイクル", r"電気自動車.*充電", r"iphone.*設定.*方法", r"スマートフォン.*接続", r"投資.*不動産", r"仮想通貨.*取引")
# Sources of broad news, the words that show their subject, and patterns of other subjects.
BROAD_SOURCES, STRICTEST_SOURCE = ("bay_area_times", "techcrunch", "wired", "venturebeat", "ieee_spectrum_ai"), "bay_area_times"
STRICT_WORDS = (
    "artificial intelligence", "machine learning", "neural network", "deep learning", "openai", "anthropic", "google ai", "meta ai", "microsoft ai",
    "chatgpt", "claude", "gemini", "gpt-", "llm", "large language model", "transformer", "generative ai", "ai model", "ai training",
    "empathetic", "empathy", "emotional intelligence", "sentiment analysis", "conversational ai", "language model", "natural language", "nlp",
    "human-ai interaction", "behavioral ai", "social ai", "agi", "artificial general intelligence",
)
WORLD_NEWS = (
    r"\b(israel|palestine|iran|gaza)\b.*\b(ceasefire|war|conflict|military)\b",
    r"\b(ukraine|russia)\b.*\b(invasion|war|sanctions)\b",
    r"\b(election|politics|senate|congress)\b.*\b(vote|campaign|policy)\b",
    r"\b(climate change|renewable energy|solar|carbon)\b.*\b(emissions|environmental|green)\b",
)
REPRESENTATIVE_WORDS = (
    "ai", "artificial intelligence", "machine learning", "neural network", "openai", "anthropic", "google ai", "meta ai", "microsoft ai",
    "chatgpt", "claude", "gemini", "gpt-", "llama", "llm", "large language model", "deep learning", "transformer",
)
BOOSTED_SOURCES = ("openai_news", "anthropic_news", "google_research_blog", "deepmind_blog")
SOURCE_BOOSTS = {"openai_news": 0.3, "anthropic_news": 0.3, "google_research_blog": 0.25, "the_decoder": 0.2, "semianalysis": 0.2, "stratechery": 0.2}
SOURCE_QUALITY = {"openai_news": 1.0, "anthropic_news": 1.0, "google_research_blog": 1.0, "the_decoder": 0.9, "venturebeat": 0.8, "techcrunch": 0.7, "the_verge": 0.7}
# Subjects and entities by which pairs of articles are aligned.
SUBJECTS = (
    ("llm", "language model", "gpt", "claude", "gemini", "chatgpt"),
    ("agent", "エージェント", "autonomous", "agentic", "multi-agent"),
    ("research", "研究", "paper", "study", "analysis"),
    ("openai", "anthropic", "google", "meta", "microsoft", "apple"),
    ("ai", "ml", "deep learning", "neural", "transformer"),
    ("api", "platform", "service", "tool", "framework"),
    ("investment", "投資", "funding", "startup", "venture", "partnership"),
)
ENTITIES = (
    "openai", "anthropic", "google", "meta", "microsoft", "apple", "nvidia", "sakana",
    "gpt", "claude", "gemini", "llama", "copilot", "mcp", "api",
    "agent", "reasoning", "multimodal", "embedding", "fine-tuning",
)
IMPORTANT = ("ai", "llm", "model", "research", "openai", "anthropic", "google", "chatgpt", "claude", "gemini", "mcp", "protocol", "agent")
NAMED_COMPANIES = (
    "OpenAI", "Google", "Meta", "Microsoft", "Anthropic", "Apple", "Amazon", "Tesla", "NVIDIA", "DeepMind", "LinkedIn", "GitHub",
    "Hugging Face", "Stability AI", "Cohere", "Inflection",
)
TECH_TERMS = (
    "ChatGPT", "GPT-4", "GPT-3", "Gemini", "Claude", "Llama", "Copilot", "Bard", "API", "CLI", "LLM", "AI", "Machine Learning", "Deep Learning",
    "Transformer", "Neural Network", "Embedding", "RAG", "Agent",
)
TOPIC_WORDS = (
    "研究者", "採用", "雇用", "人事", "資金調達", "投資", "VC", "買収", "製品", "サービス", "機能", "API", "CLI", "アップデート", "リリース",
    "技術", "モデル", "アルゴリズム", "データ", "プラットフォーム",
)
CITED_TERMS = (
    "ChatGPT", "OpenAI", "Gemini", "Claude", "Anthropic", "GPT", "LLM", "機械学習", "深層学習", "自然言語処理", "画像認識", "音声認識",
    "AI開発", "人工知能", "ニューラルネットワーク", "トランスフォーマー", "API", "SDK", "プラットフォーム", "エージェント", "自動化",
)
DEFAULT_TERMS = ("AI技術", "人工知能", "機械学習")
# Pairs of word groups whose titles don't cite each other.
CLASHING_FIELDS = (
    (("hiring", "recruitment", "採用", "人材", "linkedin", "求人"), ("research", "researcher", "研究", "技術", "model", "モデル")),
    (("economy", "economic", "経済", "失業", "雇用喪失", "job losses"), ("hiring", "recruitment", "採用", "人材獲得", "massive offers")),
    (("investment", "funding", "ipo", "valuation", "投資"), ("api", "cli", "model", "algorithm", "研究")),
    (("ollama", "local", "ローカル", "cli"), ("anthropic", "openai", "cloud", "クラウド")),
    (("game", "gaming", "ゲーム", "entertainment", "エンターテイメント"), ("safety", "research", "安全性", "研究")),
    (("hardware", "device", "デバイス", "chip", "チップ"), ("software", "api", "sdk", "ソフトウェア")),
    (("regulation", "policy", "規制", "政策", "law", "法律"), ("innovation", "breakthrough", "革新", "技術革新")),
    (("占星術", "astrology", "宇宙論", "cosmology", "スピリチュアル", "spiritual", "原初", "mystical", "cosmic"), ("gemini", "claude", "chatgpt", "openai", "anthropic", "ai", "llm", "技術", "tech")),
    (("個人的", "personal", "私の", "my experience", "感想", "体験", "日記"), ("industry", "企業", "company", "official", "announcement", "release")),
    (("creative", "art", "芸術", "創作", "novel", "小説", "poetry", "詩"), ("implementation", "api", "sdk", "technical", "技術実装")),
    (("tutorial", "how to", "使い方", "方法", "手順", "guide", "チュートリアル"), ("announcement", "release", "発表", "news", "ニュース", "発売")),
)
CLASHING_WORDS = (
    ("anthropic", "meta"), ("anthropic", "openai"), ("claude", "chatgpt"), ("google", "openai"), ("gemini", "chatgpt"),
    ("meta", "linkedin"), ("economic futures", "massive offers"), ("雇用喪失", "massive offers"), ("経済影響", "cto confirms"),
    ("経済プログラム", "top ai executives"), ("経済", "採用"), ("失業", "引き抜き"), ("雇用喪失", "人材獲得"), ("economy", "hiring"),
    ("job losses", "recruitment"), ("ollama", "anthropic"), ("ollama", "openai"), ("ローカル", "クラウド"),
    ("占星術", "gemini"), ("占星術", "claude"), ("占星術", "chatgpt"), ("astrology", "ai"), ("インド占星術", "tech"), ("原初の空間", "ai"),
    ("宇宙論", "technical"), ("詩音", "ai"), ("個人体験", "industry"), ("感想", "announcement"), ("学習中", "official"), ("自身の理解", "enterprise"),
)
CLASHING_PHRASES = (
    ("ai経済フューチャープログラム", "meta cto confirms"), ("雇用喪失への懸念", "top ai executives"), ("economic futures program", "massive offers"),
    ("原初の空間には、インド占星術の基礎が書いてある", "gemini"), ("インド占星術の基礎", "ai技術"), ("占星術", "openai"), ("詩音", "エンタープライズ"),
    ("7月5日の星読み", "技術動向"), ("個人的な体験", "業界ニュース"), ("学習中", "公式発表"), ("感想とメモ", "企業戦略"),
    ("エンジニアのためのaiの基本", "企業買収"), ("開発秘話", "技術仕様"),
)
STRICT_CLASHES = (
    (("openai", "chatgpt", "gpt"), ("anthropic", "claude")), (("openai", "chatgpt", "gpt"), ("google", "gemini", "bard")),
    (("anthropic", "claude"), ("google", "gemini", "bard")), (("sakana", "treequest"), ("openai", "gpt")),
    (("microsoft", "copilot"), ("google", "gemini")), (("hunter", "nen", "念能力"), ("ai", "llm", "technology")),
    (("xbox", "gaming"), ("ai", "llm", "research")),
)
SUBJECT_CLASHES = (
    (("sakana", "treequest", "multi-model"), ("prompt", "engineering", "fine-tuning", "zen")),
    (("xbox", "microsoft", "layoff", "emotion"), ("eu", "regulation", "legislation")),
    (("mcp", "protocol", "context"), ("general", "understanding", "理解", "基本")),
    (("openai", "chatgpt"), ("anthropic", "claude")), (("google", "gemini"), ("openai", "gpt")),
    (("research", "model", "technical"), ("hiring", "recruitment", "hr")),
)
# What content rules look for.
POINTERS = r"\b(この|その|あの|どの)\b"
POINTING = ("この", "その", "あの", "どの")
ENDINGS = ("です", "ます", "した", "きます", "。", "だ", "である")
SCHEMA_ENDING = r"(です|ます|した|きます|。)$"
POLITE, CASUAL = ("です", "ます", "でした", "ました"), ("だ", "である", "する", "した")
NUMBER = r"\d+(?:[.,]\d+)*(?:%|円|ドル|件|個|台|人|社|年|月|日|時間|分|秒|MB|GB|TB)?"
PROPER_NOUN = r"[A-Z][a-zA-Z]+|[ァ-ヶー]+(?:社|会社|Corporation|Inc|LLC|Ltd)?"
CLAUSE_MARKS = "、がしてでにをは"
CONTENT_WORD = r"[a-zA-Zァ-ヶー一-龯]{2,}"
VARIANTS = {"AI": ("人工知能", "エーアイ"), "ML": ("機械学習", "マシンラーニング"), "API": ("アプリケーションプログラミングインターフェース", "エーピーアイ"), "ChatGPT": ("チャットジーピーティー",), "OpenAI": ("オープンエーアイ",)}
FULL_FORMS = {"LLM": "大規模言語モデル", "NLP": "自然言語処理", "GPT": "Generative Pre-trained Transformer", "API": "Application Programming Interface"}
META_TEXT = (r"はい、?承知.*?しました", r"以下.*?翻訳", r"こちら.*?要約", r"について.*?です$", r"AI技術.*?です$", r"として.*?注目されています$")
SPECIFIC = r"(\d+|発表|リリース|開発|投資|企業|製品|技術|AI|研究|実装|導入|提供|改善|向上)"
TITLE_TERMS = r"(AI|技術|開発|企業|製品|サービス|リリース|発表)"
# What makes an article weigh more.
MAJOR_ENTITIES = ("OpenAI", "Google", "Meta", "Microsoft", "Apple", "Amazon", "NVIDIA", "Anthropic", "DeepMind", "GPT", "Claude", "Gemini", "ChatGPT")
IMPACT_TERMS = ("発表", "リリース", "開始", "公開", "導入", "実装", "改善", "向上", "強化", "拡大", "展開", "活用", "応用", "突破", "breakthrough")
FIGURES = r"\d+%|\d+倍|\d+[年月日]|\$\d+|¥\d+"
# Rewrites of Japanese text (pattern, replacement), in their order, and of punctuation.
REDUNDANT = (
    (r"ことができます。.*?ことができます。", "ことができます。"), (r"ことになります。.*?ことになります。", "ことになります。"),
    (r"と思われます。.*?と思われます。", "と思われます。"), (r"することが可能です。.*?することが可能です。", "することが可能です。"),
    (r"に関しては、", "については、"), (r"について述べると、", "については、"), (r"という形で", ""), (r"といった感じで", ""),
    (r"のような状況です", "です"), (r"ということが言えます", "と言えます"),
)
POLITE_FORMS = ((r"である。", "です。"), (r"だ。", "です。"), (r"([^ます])る。", "$1ます。"), (r"した。", "しました。"), (r"([^あり])ない。", "$1ません。"))
PUNCTUATION = (("，", "、"), ("．", "。"), ("！", "!"), ("？", "?"), ("（", "("), ("）", ")"))
