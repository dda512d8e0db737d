"""Word and pattern lists.  All are fixed values: substrings are matched as substrings, patterns without regard to case."""

LEGAL_WORDS = ("liability", "negligence", "lawsuit", "illegal", "RSA", "ADA", "compliance", "damages", "immunity", "permit", "building code", "DOJ", "Public Integrity", "Right to Know", "injunction", "federal", "civil action", "violation", "enforcement", "legal", "statute", "ordinance violation", "certificate of occupancy", "governmental immunity", "municipal liability")
LEGAL_PATTERNS = (r"\bcan\s+they\b", r"\bis\s+this\s+allowed\b", r"\bwhat\s+law\b", r"\bwhat\s+happens\s+if\b", r"\bis\s+it\s+legal\b", r"\bis\s+this\s+legal\b", r"\bare\s+they\s+liable\b", r"\bam\s+i\s+liable\b", r"\bwho\s+is\s+liable\b", r"\bwhat\s+are\s+the\s+requirements\b", r"\bwhat\s+does\s+the\s+law\s+say\b", r"\bwhat\s+does\s+RSA\b", r"\bunder\s+what\s+authority\b", r"\bwhat\s+legal\b")
PLANNER_LEGAL_WORDS = ("liability", "negligence", "illegal", "lawsuit", "ada", "compliance", "rsa", "statute", "damages", "immunity", "violation", "enforcement", "penalty", "sue", "legal action", "attorney", "building code")
STATE_LAW = (r"\bRSA\b", r"\bRevised Statutes\b", r"\bNew Hampshire law\b", r"\bNH law\b", r"\bstate law\b", r"\bstate statute\b", r"\bstate requirements?\b")
LIST_WORDS = (r"\blist\b", r"\bchecklist\b", r"\bsteps?\b", r"\bbullet", r"\bin a table\b", r"\bitemize\b", r"\bnumber(?:ed)?\s+(?:list|steps)\b")
RISK = (r"\bdispute\b", r"\bliab(le|ility)\b", r"\bappeal\b", r"\bviolat(e|ion)\b", r"\blegal\s+action\b", r"\bsue\b|\bsued\b", r"\boverride\b", r"\bconflict\b", r"\bchallenge\b", r"\brecourse\b", r"\bgrievance\b", r"\bcan.*\s+override\b", r"\bwrongful\b", r"\bunlawful\b", r"\billegal\b")
EXPLAINER = (r"\bwhat\s+is\b", r"\bdefine\b", r"\bexplain\b", r"\bhow\s+does\b.*\bwork\b", r"\bmeaning\s+of\b", r"\bdifference\s+between\b")
INTERPRETATION = (r"\bexplain\s+(?:this|the|my|what)\b", r"\bwhat\s+does\s+(?:this|it)\s+mean\b", r"\binterpret\b", r"\bunderstand\b.*\b(?:this|document|bill|statement|report)\b", r"\bhelp\s+(?:me\s+)?(?:understand|read|interpret)\b", r"\bcan\s+you\s+(?:explain|read|analyze)\b")
CAUSAL = (r"\bwhy\s+(?:did|has|have|is|was|were|are)\b", r"\bwhy\s+(?:the|my|our)\b", r"\bwhat\s+(?:caused|led\s+to|explains?)\b", r"\b(?:increase|decrease|change|go\s+up|go\s+down|rise|drop|jump|spike)\b.*\?", r"\breason\s+(?:for|why|behind)\b")
MECHANISM = (r"\bhow\s+(?:is|are|does|do)\b.*\b(?:calculated|determined|computed|set|established|figured)\b", r"\bhow\s+(?:is|are)\b.*\b(?:rate|tax|fee|assessment|value)\b", r"\bwhat\s+(?:is|are)\s+the\s+(?:formula|calculation|method|process)\b", r"\bhow\s+(?:do|does)\b.*\bwork\b")
BREAKDOWN = (r"\bwhat\s+(?:goes\s+into|makes\s+up|comprises?|consists?\s+of)\b", r"\bbreak\s*down\b", r"\bcomponents?\s+of\b", r"\bparts?\s+of\b", r"\bcomposition\s+of\b", r"\bwhat\s+(?:is|are)\s+(?:the\s+)?(?:different\s+)?(?:parts?|pieces?|elements?|portions?)\b", r"\bpercentage\s+(?:breakdown|composition|split)\b")
BROAD = (r"why\s+(did|does|has|have|is|was|were)", r"how\s+(is|are|was|were)\s+\w+\s+(calculated|determined|set|decided)", r"what\s+(goes|went)\s+into", r"breakdown", r"components?\s+of", r"compare", r"year[\s-]+(to|over)[\s-]+year", r"who\s+(decides|decided|determines|determined)", r"process\s+(for|of|to)", r"explain\s+(how|why)", r"what\s+factors", r"contributing\s+factors")
RECENT = ("currently", "now", "this year", "recent", "recently", "latest", "today", "right now", "at the moment", "present", "presently", "2024", "2025")
FOLLOW_UP = ("so ", "so then", "otherwise", "does that mean", "then ", "if so", "and if", "what about", "how about", "but what if", "is that", "would that", "could that", "should that", "can i", "can we", "can they")
FORBIDDEN = ("deep", "standard", "mode", "toggle", "premium", "upgrade", "shortened", "truncated")
# Phrases that an answer in prose should not have.
FORBIDDEN_PROSE = ("Bottom line", "What we know", "Unknowns that matter", "What changes", "next steps", "you may wish to", "consult counsel", "I recommend", "consider", "based on the provided documents", "the sources indicate", "It's important to note", "It should be noted", "Worth mentioning")
# Least and most words of an answer in prose, by its type.
PROSE_WORDS = (("QUICK_PROCESS", 120, 220), ("EXPLAINER", 180, 320), ("RISK_DISPUTE", 250, 450))
# Towns whose name makes a question local.
SCOPE_TOWNS = (
    *("Ossipee", "Conway", "Bartlett", "Madison", "Tamworth", "Freedom", "Effingham", "Moultonborough", "Sandwich", "Wolfeboro"),
    *("Wakefield", "Milton", "Farmington", "Rochester", "Dover", "Portsmouth", "Exeter", "Hampton", "Concord", "Manchester"),
    *("Nashua", "Keene", "Laconia", "Berlin", "Littleton", "Plymouth", "Hanover", "Lebanon", "Claremont", "Franklin"),
    *("Tilton", "Meredith", "Ashland", "Holderness", "Campton", "Thornton", "Lincoln", "Woodstock", "Franconia", "Sugar Hill"),
    *("Lisbon", "Bethlehem", "Whitefield", "Lancaster", "Gorham", "Jackson", "Albany", "Eaton", "Chatham", "Brookfield"),
)
# Domains of a question that follows up, where none is known before.
BYPASS_DOMAINS = ("zoning", "ordinance", "planning_board_docs")
HIGH_RISK = ("lawsuit", "liability", "damages", "sue", "legal action", "court", "attorney", "negligence")
BYLINE = (r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\bUpdated\b", r"\bPublished\b", r"\bReporter\b", r"\bBy\s+[A-Z][a-z]+\s+[A-Z][a-z]+", r"\bStaff\s+Writer\b", r"\bPress\s+Release\b", r"\bNews\b", r"\bArticle\b")
MINUTES = (r"\bMinutes\b", r"\bMeeting\s+Called\s+to\s+Order\b", r"\bAdjourned\b", r"\bMotion\s+(to|by)\b", r"\bSeconded\b", r"\bAll\s+in\s+favor\b", r"\bVote:\s*\d", r"\bPresent:\s", r"\bAbsent:\s", r"\bQuorum\b")
OFF_TOPIC = ("Brown property", "Brown case", "RV", "cesspool", "septic")
OFFICIAL = (r"\bDepartment\b", r"\bDOJ\b", r"\bNHDES\b", r"\bNH\s+Secretary\s+of\s+State\b", r"\bAttorney\s+General\b")
COMMON_WORDS = (
    "the", "be", "to", "of", "and", "a", "in", "that", "have", "i", "it", "for", "not", "on", "with", "he", "as", "you", "do", "at", "this", "but",
    "his", "by", "from", "they", "we", "say", "her", "she", "or", "an", "will", "my", "one", "all", "would", "there", "their", "what", "so", "up",
    "out", "if", "about", "who", "get", "which", "go", "me", "when", "make", "can", "like", "time", "no", "just", "him", "know", "take", "people",
    "into", "year", "your", "good", "some", "could", "them", "see", "other", "than", "then", "now", "look", "only", "come", "its", "over", "think",
    "also", "back", "after", "use", "two", "how", "our", "work", "first", "well", "way", "even", "new", "want", "because", "any", "these", "give",
    "day", "most", "us", "town", "board", "meeting", "vote", "motion", "member", "minutes", "public", "budget", "property", "tax", "road", "water",
    "fire", "police", "school", "planning", "zoning", "permit", "application", "hearing", "approval", "denied", "selectmen", "committee",
    "department", "office", "resident", "citizen",
)
TOPIC_TOWNS = r"\b(ossipee|conway|north conway|jackson|tamworth|bartlett|madison|albany|chatham|sandwich|effingham|freedom|moultonborough)\b"
TOPIC_WORDS = r"\b(lot merger|zoning|variance|subdivision|planning board|zba|selectmen|budget|warrant|rsa \d+[:\-]\d+[a-z\-]*|building permit|setback|wetlands)\b"
STATUTE = r"(?i)\bRSA\s+\d+[-:]?[A-Z]?(?:[-:]\d+)?"
QUESTIONS = (
    "Is this legal under RSA 91-A and who is liable for damages?",
    "Explain the tax bill, why did my assessment go up?",
    "List the steps for a building permit in Conway",
    "How is the tax rate calculated?",
    "What about the septic system?",
    "so then the board can override the vote",
    "What goes into the budget breakdown this year?",
    "Who decides under state law in Ossipee?",
    "Can they appeal a violation?",
    "I know nothing",
    "",
)
"""Questions that hit the lists; the driver's tables are invented prose that rarely does."""
ANSWERS = (
    "The board met. RSA 674:33 applies [S1]. See [L1] and [L1] and [USER].",
    "**Bottom line**\n- first point\n- second point\nConsider the standard upgrade.",
    "# Heading\n" + "word " * 300,
    "The Brown property has a cesspool near the septic field.",
    "",
)
DOMAINS = (
    ("budget", ("budget", "appropriation", "tax rate", "default budget", "overlay", "encumbrance", "fund balance", "fiscal year", "revenue", "expenditure")),
    ("zoning", ("zoning amendment", "zoning variance", "special exception", "setback", "lot coverage", "building permit", "conditional use")),
    ("environmental", ("wetlands", "shoreland", "stormwater", "septic", "groundwater")),
    ("development", ("subdivision", "site plan", "lot line adjustment", "annexation")),
    ("personnel", ("personnel", "hiring", "firing", "compensation", "benefits", "collective bargaining", "union", "grievance", "employee")),
    ("elections", ("deliberative session", "official ballot", "election", "ballot", "voter registration", "absentee", "moderator")),
    ("public_safety", ("police", "fire department", "emergency services", "ambulance")),
    ("infrastructure", ("highway", "road maintenance", "bridge", "culvert", "drainage", "water system", "sewer system", "utility")),
)
HEADINGS = (
    ("Bottom line", r"\*\*Bottom line\*\*", 0),
    ("What we know", r"\*\*What (?:we know|happened)(?:\s*\([^)]*\))?\*\*", 5),
    ("What the law generally requires", r"\*\*What the law generally requires\*\*", 5),
    ("What changes", r"\*\*(?:What changes|What the.*?(?:vote|decision)\s+(?:changes|affects)|How this typically works)\b", 4),
    ("Unknowns that matter", r"\*\*Unknowns that matter\*\*", 4),
)
TAILS = (r"\bnext\s+steps?\b", r"\bconsult\s+counsel\b", r"\byou\s+may\s+wish\s+to\b", r"\bi\s+recommend\b", r"\bwhat\s+to\s+pull\s+next\b", r"\bwhat\s+would\s+clarify\b", r"\bfurther\s+research\b", r"\bseek\s+legal\s+advice\b", r"\bconsider\s+consulting\b", r"\bassumes?\s+(?:this|it)\s+refers?\s+to\b", r"\bassuming\s+(?:this|it)\s+(?:relates?|refers?)\s+to\b", r"\bthis\s+(?:likely\s+)?refers?\s+to\s+the\b", r"\bpresumably\s+(?:about|related\s+to)\b", r"\bthe\s+analysis\s+assumes\b")
ABSOLUTE = (r"\bis\s+illegal\b", r"\bwill\s+be\s+liable\b", r"\bmust\s+result\s+in\b", r"\bguaranteed\s+to\b", r"\bwill\s+definitely\b", r"\bis\s+certainly\s+illegal\b", r"\bautomatically\s+(?:liable|responsible)\b")
PROCEDURES = (r"\bPublic\s+Integrity\s+Unit\s+(?:process|procedure|requires?)\b", r"\bDOJ\s+(?:process|procedure|requires?)\b", r"\bmust\s+file\s+(?:within|by)\s+\d+\s+days?\b", r"\bstatute\s+of\s+limitations?\s+(?:is|requires?)\s+\d+")
NH_TOWNS = ("Ossipee", "Conway", "Madison", "Freedom", "Tamworth", "Albany", "Sandwich", "Jackson", "Bartlett", "Eaton", "Effingham", "Moultonborough", "Tuftonboro", "Wolfeboro", "Wakefield", "Brookfield", "Chatham", "Hart's Location")
TOWN_BEFORE, TOWN_AFTER = ("town of ",), (", nh", ", new hampshire", " town hall", " planning board", " board of selectmen", " select board", " zoning board", " conservation")
STATE_PAPERS = (r"state\s+of\s+new\s+hampshire", r"new\s+hampshire\s+legislature", r"nh\s+rsa", r"new\s+hampshire\s+department", r"state\s+agency")
DAYS = (
    r"(?i)(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}",
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b",
    r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b",
    r"(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?\s+\d{1,2},?\s+\d{4}",
)
STATEWIDE_NAMES = (r"\bRSA\b", r"\bNHMA\b", r"\bhandbook\b", r"\bstatewide\b", r"\bNew Hampshire (?:Municipal|Town|City)", r"\bgencourt\.state\.nh", r"\bstate law\b")
RATE_TIERS = (("messages", 1, 20), ("sessions", 1, 10), ("api", 1, 100), ("uploads", 5, 30), ("strict", 1, 5))
"""Name, minutes of a window, requests allowed in one."""
PAPERS = (("both", "conway/minutes-2024.pdf"), ("both", "RSA 91-A guide.pdf"), ("state", "NHMA Handbook"), ("state", "gencourt.state.nh.us/rsa"), ("odd", "New Hampshire Townships"), ("odd", "interstate lawn.txt"))
PLANNER_TOPICS = ("liability", "negligence", "compliance", "violation", "enforcement", "ada", "accessibility", "permit", "zoning", "variance", "building code", "immunity", "damages", "lawsuit", "legal", "illegal", "ordinance")
PLANNER_BOARDS = ("select board", "selectboard", "planning board", "zba", "zoning board", "conservation commission", "budget committee", "school board")
PLACE = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Park|Property|Building|Road|Street|Avenue|Lane|Drive|School|Library|Center|Hall)\b"
PLANNED = ("What did the planning board say about Constitution Park? Is it illegal?", "Who pays for the Main Street School Library and Mill Road, under RSA 674 and the building code or a lawsuit", "Budget committee and zba", "! now", "")
RETRY_CODES, RETRY_TEXTS = (503, 429, 500, 502, 504), ("service unavailable", "temporarily unavailable", "rate limit", "quota exceeded", "timeout", "econnreset", "network error")
QUOTA_TEXTS = ("quota", "RESOURCE_EXHAUSTED")
CLAIMS = (
    "The fence is illegal, and the owner will be liable.",
    "The DOJ process takes months. You must file within 30 days [S1].",
    "An heir must file by 10 days after notice and the Public Integrity Unit requires a form. The statute of limitations is 3 years.",
    "Nothing is certain here.",
    "",
)
ANALOGY = (r"as\s+a\s+separate\s+example", r"in\s+an?\s+unrelated\s+(?:matter|case|situation)", r"this\s+is\s+not\s+the\s+same\s+issue", r"as\s+an?\s+analogy", r"for\s+comparison", r"in\s+contrast", r"unlike\s+this\s+situation", r"different(?:ly)?\s+from", r"separately", r"in\s+another\s+context")
FACILITY, EVENT, PROPERTY, BOARD = "park|hall|station|library|center|school|department", "vote|meeting|hearing|warrant|session", "property|parcel|lot|subdivision|development|project|trail|road|bridge", "board|commission|committee|trustees"
SITUATION_WORDS = (
    r"\b(select\s*board|selectboard|planning\s*board|zba|zoning\s*board|conservation\s*commission|budget\s*committee|school\s*board|trustees|recreation\s*committee|heritage\s*commission|library\s*trustees|cemetery\s*trustees|parks?\s*commission)\b",
    r"\b(town\s*hall|library|fire\s*station|police\s*station|highway\s*department|transfer\s*station|recreation\s*center|community\s*center|senior\s*center|school|elementary|middle\s*school|high\s*school)\b",
    r"\b(vote|voted|voting|meeting|hearing|warrant|article|motion|approved|denied|tabled|deliberative\s*session|town\s*meeting)\b",
    r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s*\d{4}\b",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b(rsa\s*\d+[-:]\w+|rsa\s*\d+|nh\s*law|statute|ordinance|regulation)\b",
    r"\b(park|trail|sidewalk|road|bridge|intersection|property|parcel|lot|subdivision|development|construction|renovation|expansion)\b",
)
"""Boards, facilities, events, three forms of a date, law, property."""
SITUATION_DATES = SITUATION_WORDS[3:6]
EVENT_MARKERS = r"\b(?:vote|meeting|hearing|warrant|decision|controversy|project|dispute|lawsuit|case|issue)\b"
BROADENING = (r"\bhow\s+does\s+(?:this|it)\s+work\s+(?:statewide|in\s+nh|generally|across)\b", r"\bwhat\s+about\s+other\s+towns?\b", r"\bswitching\s+topics?\b", r"\bdifferent\s+(?:topic|question|subject)\b", r"\bgenerally\s+speaking\b", r"\bin\s+general\b", r"\bacross\s+(?:new\s+hampshire|nh|the\s+state)\b", r"\bstatewide\b")
# Phrases that point at what was spoken of.
POINTED_AT = (
    *("that vote", "the vote", "this vote", "that decision", "the decision", "this decision", "that meeting", "the meeting", "this meeting"),
    *("that case", "the case", "this case", "that situation", "the situation", "this situation", "that project", "the project", "this project"),
    *("that issue", "the issue", "this issue", "that article", "the article", "this article", "that property", "the property", "this property"),
    *("as mentioned", "as discussed", "we were discussing", "going back to", "regarding the", "about the earlier"),
)
PROPER_NOUNS = (
    r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:Park|Board|Committee|Commission|Department|Street|Road|Drive|Avenue|Lane|Court|Project|Property|Case|Center|School|Building|Hill|Lake|Pond|River|Creek|Brook|Bridge|Beach)\b",
    r"(?i)\b(?:the\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:vote|motion|amendment|proposal|resolution|ordinance|variance|appeal|hearing|meeting)\b",
    r"(?i)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:enforcement|violation|complaint|investigation)\b",
    r"\b(?:Select|Planning|Zoning|School|Library|Conservation)\s+(?:Board|Committee|Commission)\b()",
    r"(?i)\b([A-Z][a-z]+)(?:'s)?\s+(?:property|land|lot|parcel|home|house|residence|business)\b",
    r"(?i)\b(?:the\s+)?([A-Z][a-z]+)\s+(?:case|matter|situation|issue)\b",
    r"(?i)\b(?:the\s+)?(rv|r\.v\.|campground|cesspool|septic|sewage)\s+(?:enforcement|violation|matter|issue|case|problem)\b",
    r"(?i)\b(?:the\s+)?(\w+)\s+(?:enforcement|violation)\s+(?:case|matter|action)\b",
    r"(?i)\b(?:the\s+)?(\w+)\s+(?:property|lot)\s+(?:violation|enforcement|dispute)\b",
    r"(?i)\b(?:re(?:garding)?|concerning|about)\s+(?:the\s+)?(\w+)\s+(?:matter|case|issue)\b",
)
COMMON_BOARDS = ("select board", "planning board", "zoning board", "school board")
ISSUE_PROPERTY = (r"(?i)\b(\d+)\s+([\w\s]+(?:road|street|lane|drive|avenue|way|place|court|circle|boulevard))\b", r"(?i)\bmap\s+\d+\s+lot\s+\d+", r"(?i)\btax\s+map\s+\d+")
ISSUE_BOARDS = (r"\b(selectboard|selectmen|board\s+of\s+selectmen)\b", r"\b(planning\s+board)\b", r"\b(zoning\s+board|ZBA)\b", r"\b(conservation\s+commission)\b", r"\b(budget\s+committee)\b", r"\b(school\s+board)\b", r"\b(library\s+trustees?)\b", r"\b(town\s+meeting)\b")
ISSUE_TOPICS = (
    ("RSA statute", r"\bRSA\s+\d+[:\-]\d+"),
    ("Right-to-Know law", r"\bRight[\s-]to[\s-]Know"),
    ("public hearing requirements", r"\bpublic\s+hearing"),
    ("default budget", r"\bdefault\s+budget"),
    ("warrant articles", r"\bwarrant\s+article"),
    ("notice requirements", r"\bnotice\s+requirement"),
    ("open meeting law", r"\bopen\s+meeting"),
    ("recusal/conflict of interest", r"\brecusal"),
    ("voting procedures", r"\bvote|voting"),
    ("sit-lien", r"\bsit\s*-?\s*lien"),
    ("zoning variance", r"\bvariance"),
    ("subdivision", r"\bsubdivision"),
    ("tax exemption", r"\bexemption"),
)
ISSUE_ACTIONS = (r"\b(approved|denied|tabled|continued|voted|granted|rejected)\b", r"\b(appeal|amend|reconsider|rehearing)\b", r"\b(apply|submit|request)\b")
ISSUE_DATES = SITUATION_DATES[:2]
ISSUE_SOURCE = "The planning board denied the variance at 12 Moose Hill Road (tax map 12) after a public hearing on March 5, 2024; an appeal is due 4/5/2024."
MINUTES_NAMES = (r"minutes", r"mtg[\s_-]?\d{4}", r"meeting[\s_-]?\d{4}", r"\b(pb|bos|zba|cc)[\s_-]?\d{1,2}[\s_-]?\d{1,2}[\s_-]?\d{2,4}", r"selectmen.*\d{4}", r"planning.*board.*\d{4}")
MINUTES_TEXT = (r"meeting\s+minutes", r"minutes\s+of\s+(the\s+)?meeting", r"board\s+of\s+selectmen\s+meeting\s*minutes", r"planning\s+board\s+meeting\s*minutes", r"zoning\s+board\s+of\s+adjustment\s+meeting\s*minutes", r"budget\s+committee\s+meeting\s*minutes", r"conservation\s+commission\s+meeting\s*minutes", r"regular\s+meeting", r"special\s+meeting", r"work\s+session", r"call\s+to\s+order", r"roll\s+call", r"members\s+present:", r"meeting\s+called\s+to\s+order")
TEXT_BOARDS = (("Planning Board", r"planning\s+board"), ("Board of Selectmen", r"board\s+of\s+selectmen"), ("Select Board", r"select\s*board"), ("Zoning Board of Adjustment", r"zoning\s+board\s+of\s+adjustment|\bzba\b"), ("Budget Committee", r"budget\s+committee"), ("Conservation Commission", r"conservation\s+commission"), ("School Board", r"school\s+board"), ("Heritage Commission", r"heritage\s+commission"), ("Recreation Commission", r"recreation\s+commission"))
PAGES = (
    ("minutes-2024.pdf", "TOWN OF CONWAY, NH\nPlanning Board\nMeeting Minutes of March 5, 2024\nCall to order at 7"),
    ("budget.pdf", "Town of hart's location\nAnnual budget"),
    ("x.pdf", "STATE OF NEW HAMPSHIRE\nDepartment of Revenue"),
    ("bos 1-2-24.txt", "Board of Selectmen of Ossipee 1/2/2024"),
    ("y.txt", ""),
    ("notes.txt", "Notes\nThe Tamworth Planning Board met with the heritage commission on 2024-03-07\nand Feb. 3, 2023"),
    ("hearing.pdf", "Town of New Hampshire NH\r\nTOWN  OF  Wolfeboro New Hampshire\r\nsigned 3/4/2022"),
)
LISTS = (
    "**Bottom line**\nYes.\n**What we know**\n- a fact [L1]\n- two\n**What the law generally requires**\n- RSA 674:33 [S1]\n**What changes**\n- little\n**Unknowns that matter**\n- cost",
    "**What we know**\n- one\n**Bottom line**\nNo. Consult counsel for next steps.",
    "plain prose",
)
