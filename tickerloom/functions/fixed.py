"""Word lists, patterns, weights and thresholds that results depend on. Plain data, no logic."""

# --- Fixed values: sport vocabularies (strong = league terms, team = clubs and firm vocabulary, weak = hints) --------------
LEXICON = {
    "basketball": {
        "strong": ["NBA", "WNBA", "March Madness", "NBA Finals", "NBA Draft", "WNBA Draft"],
        "team": [
            "Celtics", "Nets", "Knicks", "76ers", "Sixers", "Raptors", "Bulls", "Cavaliers", "Cavs", "Pistons", "Pacers",
            "Bucks", "Hawks", "Hornets", "Wizards", "Nuggets", "Timberwolves", "Thunder", "Trail Blazers", "Blazers", "Jazz",
            "Warriors", "Clippers", "Lakers", "Suns", "Mavericks", "Mavs", "Rockets", "Grizzlies", "Pelicans", "Spurs",
            "Miami Heat", "Orlando Magic", "Lynx", "Aces", "Sparks", "Mystics", "Valkyries", "Mercury", "Indiana Fever",
            "Atlanta Dream", "Chicago Sky", "Connecticut Sun", "Dallas Wings", "New York Liberty", "Seattle Storm",
            "Portland Fire", "Toronto Tempo", "point guard", "three-pointer", "three-pointers", "triple-double", "rebounds", "dunk",
        ],
        "weak": ["Kings", "Heat", "Magic", "Dream", "Sky", "Fever", "Storm", "Fire", "Liberty", "Wings", "Tempo", "Sun", "layup", "buzzer-beater"],
    },
    "football": {
        "strong": ["NFL", "Super Bowl", "College Football Playoff", "Heisman", "Pro Bowl", "NFL Draft", "FBS"],
        "team": [
            "Bills", "Dolphins", "Patriots", "Ravens", "Bengals", "Browns", "Steelers", "Texans", "Colts", "Jaguars", "Titans",
            "Broncos", "Chiefs", "Raiders", "Chargers", "Cowboys", "Eagles", "Commanders", "Bears", "Packers", "Vikings",
            "Falcons", "Saints", "Buccaneers", "Bucs", "49ers", "Seahawks", "Rams", "quarterback", "wide receiver",
            "running back", "linebacker", "tight end", "touchdown", "touchdowns", "Big Ten", "SEC", "Big 12", "ACC",
        ],
        "weak": [
            "Giants", "Jets", "Lions", "Cardinals", "Panthers", "Alabama", "LSU", "Ole Miss", "Vanderbilt", "Georgia",
            "Mississippi", "Ohio State", "Michigan", "Notre Dame", "Oklahoma", "Clemson", "Florida State", "Auburn",
            "Tennessee", "Texas A&M", "Nebraska", "Penn State", "NC State", "Kentucky", "field goal", "Week 1", "Week 2",
            "Week 3", "Week 4", "Week 5", "WR", "QB", "RB",
        ],
    },
    "baseball": {
        "strong": ["MLB", "Major League Baseball", "World Series", "Cy Young", "MLB Draft", "Grapefruit League", "Cactus League"],
        "team": [
            "Yankees", "Red Sox", "Blue Jays", "Orioles", "Rays", "Guardians", "Tigers", "Royals", "Twins", "White Sox",
            "Astros", "Angels", "Athletics", "Mariners", "Braves", "Marlins", "Mets", "Phillies", "Nationals", "Cubs",
            "Reds", "Brewers", "Pirates", "Diamondbacks", "D-backs", "Rockies", "Dodgers", "Padres", "home run", "home runs",
            "walk-off", "strikeouts", "bullpen", "AL West", "AL East", "AL Central", "NL West", "NL East", "NL Central",
            "grand slam", "no-hitter", "balk", "walks it off", "walked off", "strikeout", "RBI single", "two-run", "three-run",
            "stolen base",
        ],
        "weak": ["Rangers", "Giants", "Cardinals", "homer", "RBI", "ERA", "pitcher", "innings", "wild card", "slam"],
    },
}
PROFILE_TERMS = {
    "basketball": ["NBA", "WNBA", "college basketball"],
    "football": ["NFL", "college football"],
    "baseball": ["MLB", "Major League Baseball"],
    "boxing": ["boxing match", "boxing title fight", "WBC", "WBA", "IBF", "WBO"],
    "mma": ["UFC", "mixed martial arts", "Bellator MMA"],
    "soccer": ["MLS", "Premier League", "Champions League", "UEFA", "La Liga", "Serie A", "Bundesliga", "World Cup soccer"],
    "hockey": ["NHL"],
    "tennis": ["ATP Tour", "WTA Tour", "Wimbledon", "US Open tennis", "Grand Slam tennis"],
    "golf": ["PGA Tour", "LPGA Tour", "Masters Tournament golf", "Ryder Cup"],
    "motorsports": ["Formula 1", "NASCAR", "IndyCar"],
    "olympics": ["Olympics", "Olympic Games", "IOC"],
}
CONTRADICTIONS = {
    "soccer": ["goalkeeper", "striker", "midfielder", "FIFA", "transfer window", "Ballon d'Or", "LaLiga", "Ligue 1", "Europa League"],
    "hockey": ["Stanley Cup", "power play goal"],
}
TERM_GUARDS = {
    "NBA": r"(?i)\b(Niger|Nigeria|Nigerian|Bar Association|lawyers?|National Building)\b",
    "SEC": r"(?i)\b(Securities|Exchange Commission|fraud|filings?|investors?|SEC charges|SEC sues)\b",
    "ACC": r"(?i)\b(cement|Adani|Ltd|shares|accounting)\b",
    "FBS": r"(?i)\b(Broadcasting|Bank)\b",
}
NEUTRAL_PHRASES = ["Special Olympics", "Junior Olympics", "Olympic Park"]
EVIDENCE_WEIGHTS = {"strong": 3, "team": 2, "weak": 1}

# --- Fixed values: teams and leagues as entities ----------------------------------------------------------------------------
NOT_TEAMS = [
    "NBA", "WNBA", "NFL", "MLB", "FBS", "SEC", "ACC", "WR", "QB", "RB", "RBI", "ERA", "Big Ten", "Big 12", "Heisman",
    "Pro Bowl", "Super Bowl", "World Series", "Cy Young", "March Madness", "Grapefruit League", "Cactus League",
]
TEAM_ALIASES = {
    "sixers": "76ers", "cavs": "cavaliers", "mavs": "mavericks", "bucs": "buccaneers", "d-backs": "diamondbacks",
    "blazers": "trail blazers", "miami heat": "heat", "orlando magic": "magic", "indiana fever": "fever",
    "atlanta dream": "dream", "chicago sky": "sky", "connecticut sun": "sun", "dallas wings": "wings",
    "new york liberty": "liberty", "seattle storm": "storm", "portland fire": "fire", "toronto tempo": "tempo",
}
PRO_NICKNAMES = [
    "Giants", "Jets", "Lions", "Cardinals", "Panthers", "Rangers", "Kings", "Heat", "Magic", "Dream", "Sky", "Fever", "Storm",
    "Fire", "Liberty", "Wings", "Tempo", "Sun",
]
LEAGUES = ["NBA", "WNBA", "NFL", "MLB", "FBS", "NCAA", "NHL", "MLS"]
COLLEGE_LEAGUES = ["ncaa", "fbs"]
PRO_LEAGUES = ["nba", "wnba", "nfl", "mlb", "nhl", "mls"]
LEAGUE_TIER = {
    "nba": "professional", "wnba": "professional", "nfl": "professional", "mlb": "professional", "nhl": "professional",
    "mls": "professional", "ufc": "professional", "boxing": "professional", "pga": "professional", "ncaab": "college",
    "ncaaf": "college", "milb": "developmental", "olympics": "international", "intl-soccer": "international",
}
COLLEGE_WORDS = r"(?i)\b(?:college|ncaa|fbs|heisman|march madness|big ten|big 12|sec|acc|freshman|sophomore|campus|bowl game)\b"

# --- Fixed values: words that are no names (roles, calendar, media, places, competitions) ------------------------------------
NOT_NAMES = (
    "a an the and or of in on at to for from with by as is are was were be how what why who when where watch week game games "
    "rookie former star veteran ace new top first final another mic opportunity resurgent eleventh three key keys "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september "
    "october november december sept jan feb mar apr jun jul aug oct nov dec today tonight yesterday "
    "nfl nba mlb wnba nhl ncaa fbs mls cf cbs espn tv live stream channel roundup report recap preview predictions "
    "quarterback pitcher catcher guard forward center receiver tackle safety kicker punter shortstop outfielder infielder "
    "qb wr rb lb dt de te ol lg rg lt rt cb ss fs pg sg sf pf ml al nl coach manager mr mrs dr jr sr ii iii "
    "no not yes his her their its our and but "
    "pittsburgh kansas city york los angeles san francisco diego miami houston atlanta chicago boston baltimore cleveland "
    "detroit seattle denver dallas phoenix toronto tampa bay oakland minnesota milwaukee cincinnati philadelphia washington "
    "colorado texas louisiana ohio michigan georgia florida carolina tennessee kentucky alabama indiana arizona oregon utah nevada "
    "premier league cup open championship championships playoff playoffs series division conference trophy tournament final "
    "finals classic bowl"
)

# --- Fixed values: text comparison ------------------------------------------------------------------------------------------
NUMBER_WORDS = {w: str(i + 1) for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split())}
STOPWORDS = (
    "a an the and or but of in on at to for from with by as is are was were be been it its his her their this that these those "
    "than then after before over past into out up down off vs vs. v not no has have had will can how what who why when s us we "
    "our new one"
).split()
SOURCE_SUFFIX = r"\s[–—|]\s[^–—|]{2,60}$"
PUBLISHER_WORDS = r"(?i)\b(news|times|post|sports?|radio|fm|am|herald|journal|tribune|gazette|weather|network|daily|press|report|online|live|tv)\b"

# --- Fixed values: urls and publishers ---------------------------------------------------------------------------------------
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_reader", "fbclid",
    "gclid", "mc_cid", "mc_eid", "ocid", "ncid", "cmpid", "igshid", "ref_src", "mkt_tok", "yclid", "msclkid", "dclid",
    "_hsenc", "_hsmi",
]
KNOWN_DOMAINS = [
    "apnews.com", "reuters.com", "espn.com", "cbssports.com", "foxsports.com", "nbcsports.com", "yahoo.com", "usatoday.com",
    "nytimes.com", "theathletic.com", "si.com", "bleacherreport.com", "sportingnews.com", "theguardian.com", "bbc.com",
    "bbc.co.uk", "washingtonpost.com", "cnn.com", "nbcnews.com", "foxnews.com", "sportsnet.ca", "tsn.ca",
    "profootballtalk.com", "espnfrontrow.com", "nba.com", "wnba.com", "nfl.com", "mlb.com", "ncaa.com", "nhl.com",
    "mlssoccer.com", "pgatour.com", "formula1.com", "ufc.com", "olympics.com",
]
LOW_QUALITY_DOMAINS = [
    "covers.com", "prizepicks.com", "actionnetwork.com", "oddschecker.com", "vegasinsider.com", "sportsbookreview.com",
    "bettingpros.com", "oddsshark.com", "sportsbettingdime.com", "lines.com", "underdogfantasy.com", "draftkings.com",
    "fanduel.com",
]

# --- Fixed values: intake patterns -------------------------------------------------------------------------------------------
BETTING = [
    r"(?i)\bbest bets?\b", r"(?i)\bparlays?\b", r"(?i)\b(player|touchdown|prop) (props?|bets?)\b", r"(?i)\bprop bets?\b",
    r"(?i)\bsportsbooks?\b", r"(?i)\bpromo codes?\b", r"(?i)\bbonus bets?\b",
    r"(?i)\bbetting (odds|lines?|primer|preview|picks|tips|guide)\b", r"\bDFS\b",
    r"(?i)\bfantasy (football|baseball|basketball|sleepers?|rankings?|advice|picks?|injury tracker|lineups?|waiver)\b",
    r"(?i)\b(picks?|predictions?)\b.*\b(odds|spread|props?|against the spread|best bets?|parlay)\b",
    r"(?i)\b(odds|spread|props?|against the spread|best bets?|parlay)\b.*\b(picks?|predictions?)\b",
]
ODDS_IDIOM = r"(?i)\b(against (all |the )?odds|beat(ing|s)? the odds|defy(ing)? the odds|odds and ends)\b"
BARE_ODDS = r"(?i)\bodds\b"
TEMPLATE_PAGES = [
    r"(?i)\b(Game Summary|Game Story,? Scores/Highlights|Game Preview|Preview)\s*[-–:]?\s*\d{1,2}/\d{1,2}/\d{2,4}\s*$",
    r"\b[A-Z][a-z]{2} \d{1,2}, \d{4} Game Summary\s*$",
    r"\bvs\.? .+ [-–] [A-Z][a-z]+ \d{1,2}, \d{4}\s*$",
    r"(?i)\bStream Live Sports\b",
]
VIDEO_TITLES = [r"(?i)^(condensed game|field view|resumen|hls|highlights?)\s*[:\-]", r"(?i)^highlights? from\b"]
VIDEO_PATH = r"(?i)/(videos?|watch)(/|$)"
SPANISH_CLIP = r"(?i)\b(resumen|jugadas destacadas)\b"
HISTORICAL_STATS = r"(?i)\b(19\d{2}|200\d)\b.*\b(situational )?(stats|statistics)\b\s*$"

# --- Fixed values: event rules (type, weight, pattern); a rule of weight 1 counts its distinct matches, three at most ---------
EVENT_RULES = [
    ("preview", 3, r"\bhow to watch\b|\bwhere to watch\b|\bhow to stream\b|\bviewing options\b|\blive ?stream\b|\bstart time\b|\bwhat to watch\b|\bthings to watch\b"),
    ("preview", 3, r"\bpredictions?\b|\bpreview\b|\bkeys? to (?:victory|the game|success)\b|\bkey matchups?\b|\brooting guide\b|\bx-factors?\b|\bwhat to expect\b|\blineups?\b"),
    ("preview", 3, r"^game \d+:|\bgame thread\b|\bgameday\b"),
    ("preview", 1, r"\bdiscussion\b|\blive!|\bmatchups?\b"),
    ("game-result", 3, r"\b(?:beats?|defeats?|defeated|routs?|routed|blanks?|blanked|stuns?|outlasts?|crush(?:es|ed)?|tames?|tamed|clinch(?:es|ed)?|sweeps?|swept|edges?|edged|topped|tops|dominat(?:e|es|ed)|cruis(?:e|es|ed)|overpower(?:s|ed)?|thump(?:s|ed)?|outslug(?:s|ged)?)\b"),
    ("game-result", 3, r"\b(?:loss|defeat|win|victory)\s+(?:to|over|against|vs\.?)\b|\bleads? (?:the )?[\w.'’ -]{1,30}?\b(?:to|past|over)\b|\bto (?:a|the) (?:win|victory|loss)\b|\bfinal score\b"),
    ("game-result", 3, r"\bshuts? out\b|\bshut out\b|\bwalks? off\b|\bwalk-?off\b|\bwalked off\b|\bwalks it off\b|\blifts?\b|\blifted\b|\brall(?:y|ies|ied)\b|(?:,|\band)\s+top\b"),
    ("game-result", 1, r"\bpast\b|\bover\b|\bwins?\b|\bwon\b|\bwinning\b|\bvictory\b|\bloss\b|\bloses?\b|\blost\b|\bdrops?\b|\bfalls? to\b|\bhomers?\b|\bhome runs?\b|\bgrand slam\b|\bstrikeouts?\b|\binnings?\b|\bcomeback\b|\bsqueezes?\b|\bstrands?\b|\bsquanders?\b"),
    ("injury", 3, r"\brul(?:e|es|ed) out\b|\bout for (?:the )?(?:season|year|weeks?|months?)\b|\btorn\b|\bacl\b|\bsurgery\b|\bplaced on (?:the )?(?:il|ir|injured)\b|\binjured list\b|\bwill miss\b|\bsidelined\b"),
    ("injury", 2, r"\binjur(?:y|ies|ed)\b|\bquestionable\b|\bdoubtful\b|\bday-to-day\b|\bconcussion\b|\bfracture[sd]?\b"),
    ("injury", 1, r"\bhamstring\b|\bknee\b|\bankle\b|\bshoulder\b|\bstrain\b|\bsprain\b|\bachilles\b|\boblique\b|\bgroin\b|\bcalf\b|\bwrist\b|\belbow\b|\bhip\b|\bfoot\b|\bthumb\b|\bquad\b|\brib\b|\bback\b|\bneck\b"),
    ("injury", 2, r"\bout (?:vs\.?|against|for (?:the )?(?:game|season|week|rest))\b"),
    ("trade", 3, r"\btrades?\b|\btraded\b|\btrading\b|\bdealt\b|\btrade (?:talks|rumors?|request)\b"),
    ("trade", 2, r"\bacquires?\b|\bacquired\b|\bblockbuster deal\b"),
    ("signing", 3, r"\bsigns?\b|\bsigned\b|\bagrees? to\b|\bre-?signs?\b|\binks?\b|\bfree agen(?:t|cy)\b|\bcontract extension\b|\bextension\b|\bmulti-?year\b"),
    ("transaction", 3, r"\bwaives?\b|\bwaived\b|\bdesignated for assignment\b|\bcalled up\b|\bcalls? up\b|\bpractice squad\b|\broster move\b|\bactivates?\b|\bwaiver claim\b"),
    ("transaction", 2, r"\belevat(?:e|es|ed)\b|\breinstates?\b|\breleases? (?:the )?(?:veteran|player)\b|\bpromot(?:es|ed) \w+ from\b"),
    ("record", 3, r"\b(?:breaks?|ties?|sets?|tied|broke|set)\b[^.]{0,40}\brecord\b"),
    ("record", 2, r"\brecord\b|\bmilestone\b|\ball-time\b|\bcareer-?high\b|\bfranchise (?:record|history)\b|\bhistoric\b"),
    ("discipline", 3, r"\bsuspend(?:s|ed)?\b|\bsuspension\b|\bfined\b|\bfines\b|\bejected\b|\barrest(?:ed)?\b|\blawsuit\b|\bsues?\b|\bsued\b|\bbanned\b|\bbans?\b|\bdisciplin\w*"),
    ("discipline", 2, r"\bcharged\b|\binvestigation\b|\bauthorities\b|\bfacing backlash\b|\bpenalt(?:y|ies)\b"),
    ("coaching", 3, r"\bfires? (?:its |their |the )?(?:head |offensive |defensive |general |interim |new )?(?:coach|manager|coordinator|gm|president|skipper)\b|\bfired\b(?! up)|\bhires?\b|\bhired\b|\bparts? ways\b|\bsteps? down\b|\bresigns?\b|\bcoaching (?:change|search|staff)\b|\binterim (?:head |general )?(?:coach|manager)\b"),
    ("coaching", 2, r"\bhead coach\b|\bcoordinator\b|\bmanager\b"),
    ("draft", 3, r"\bmock draft\b|\bdraft (?:pick|class|prospect|night|order|stock)\b|\bexpansion draft\b|\bdrafted\b|\bselected (?:no\.|first|second)"),
    ("draft", 2, r"\bdraft\b"),
    ("retirement", 3, r"\b(?:announces?|announced) (?:his |her |their )?retirement\b|\bretire(?:s|d) from\b|\bretiring\b|\bto retire\b|\bretires? after\b|\bhangs? up (?:his|her) (?:boots|cleats|gloves|skates)\b"),
    ("retirement", 1, r"\bretirement\b"),
    ("death", 3, r"\bdies\b|\bdied\b|\bdeath\b|\bpass(?:es|ed) away\b|\bkilled\b|\bmourn(?:s|ing)?\b|\bfuneral\b"),
    ("business", 3, r"\bsale of\b|\bownership\b|\bprivate equity\b|\btv (?:deal|rights)\b|\bbroadcast rights\b|\brelocat\w+|\bcollective bargaining\b|\bblock-?out\b|\bfranchise value\b|\bvaluation\b"),
    ("business", 2, r"\bstadium\b|\barena\b|\bexpansion\b|\bsponsor\w*|\bpolicy change\b|\bshoe\b|\bendorsement\b"),
]
EVENT_PRIORITY = ["death", "retirement", "trade", "signing", "discipline", "coaching", "injury", "draft", "transaction", "record", "business", "preview", "game-result"]
FUTURE_RESULT = r"\b(?:may|might|will|could|would|should|hopes? to|looking to|looks to|needs? to|how to|ways? to)\s+(?:[\w'’-]+\s+){0,3}?(?:beat|defeat|topple|rout|sweep|steamroll|outlast|stun|crush|tame)\b"
COMPATIBLE_EVENTS = [("trade", "signing"), ("trade", "transaction"), ("signing", "transaction"), ("game-result", "record")]
PERSON_SENSITIVE = ["injury", "signing", "trade", "discipline", "coaching", "retirement", "death", "transaction"]

# --- Fixed values: clustering thresholds and weights ----------------------------------------------------------------------------
SEARCH_FLOOR, NEAR_IDENTICAL, HIGH, MEDIUM = 0.3, 0.85, 0.72, 0.45
EXACT_WINDOW_HOURS, SHORT_WINDOW_HOURS, LONG_WINDOW_HOURS, SEARCH_WINDOW_HOURS = 48, 12, 24, 48
NEIGHBOUR_LIMIT, SPAN_FACTOR = 80, 2
EVENT_AGREEMENT_SCORE = {"same": 1.0, "compatible": 0.7, "unknown": 0.35, "conflict": 0.0}

# --- Fixed values: ranking ------------------------------------------------------------------------------------------------------
SPORT_WEIGHT = {
    "basketball": 100, "football": 95, "baseball": 90, "boxing": 70, "mma": 70, "soccer": 70, "hockey": 65, "olympics": 65,
    "tennis": 60, "golf": 55, "motorsports": 55, "other": 45, "unknown": 45,
}
TIER_POINTS = {"professional": 20, "international": 16, "unspecified-major": 10, "college": 6, "developmental": 0, "unspecified": 20}
EVENT_IMPORTANCE = {
    "death": 55, "trade": 45, "coaching": 45, "retirement": 45, "injury": 40, "discipline": 40, "signing": 35, "record": 35,
    "business": 30, "draft": 30, "transaction": 20, "game-result": 15, "other": 10, "unknown": 10, "preview": -15,
}
NEWSY = ["trade", "signing", "injury", "coaching", "discipline", "retirement", "death", "business", "draft", "transaction", "record"]
STRONG_NEWS = ["trade", "signing", "injury", "coaching", "discipline", "retirement", "death", "record"]
BREAKING = ["trade", "signing", "injury", "coaching", "discipline", "retirement", "death"]
STAKES = r"(?i)\b(?:nba|wnba) finals\b|\bfinals (?:mvp|game)\b|\bworld series\b|\bsuper bowl\b|\bconference finals\b|\bchampionship\b|\bnational title\b|\btitle game\b|\bgame [5-7]\b|\bwin(?:s|ning)? (?:the )?(?:title|crown)\b|\b(?:retain|retains|defend|defends|win|wins|won|claim|claims|capture|captures)\b[^.]{0,30}\b(?:title|belt|crown)\b"
RETROSPECTIVE = r"(?i)\b(?:world series|super bowl|(?:nba|wnba|conference) finals|championship|national title)\s+(?:anniversary|reunion|replay|memories|tribute|retrospective)\b"
SPECULATIVE = r"(?i)\brumou?rs?\b|\bspeculat\w*|\bcould\b|\blikely\b|\bmight\b|\bwould\b|\bpredict\w*|\bmock\b|\bodds\b|\bbet(?:s|ting)?\b|\bparlay\b|\bfantasy\b|\bprops?\b|\bpicks?\b|\bhow to watch\b|\bwhat to know\b|\bwish ?list\b|\bopinion\b|\btake\b|\bpower rankings?\b"
BETTING_CLUSTER = r"(?i)\b(?:bonus code|promo code|sportsbook|best bets?|free bets?|prop bets?|parlay|betting (?:odds|picks|preview|guide|tips)|odds (?:and|&) (?:picks|predictions)|bet \$?\d+|bet365|draftkings|fanduel|caesars|betmgm|fantasy (?:football|basketball|baseball|hockey)|fantasy (?:start|sit|rankings?|waiver|draft)|dfs picks|start/sit)\b"
PRIORITY_BANDS = [(210, 1), (170, 2), (130, 3)]
DESKS = {"basketball": "run", "football": "huddle", "baseball": "diamond", "boxing": "fight-desk", "mma": "fight-desk", "soccer": "world-game"}
OTHER_DESK = "across-the-board"
DESK_ORDER = ["run", "huddle", "diamond", "fight-desk", "world-game", "across-the-board"]
SLATE_DEPTH = {"lead": 1, "wire": 6, "now": 10, "run": 8, "huddle": 7, "diamond": 6, "fight-desk": 4, "world-game": 4, "across-the-board": 4}
DIVERSITY = {"team_section": 2, "team_slate": 3, "sport_share": 0.4, "type_share": 0.5, "dominant_sources": 6, "same_event": 2, "now_floor": 160.0}
LEGACY_TIER = {"professional": 1.0, "international": 0.92, "college": 0.8, "other": 0.7}
LEGACY_URGENCY = {"breaking": 40, "developing": 20, "none": 0}
LEGACY_CREDIBILITY = {"staff": 10, "wire": 6, "syndicated": 3, "aggregated": 0}
LEGACY_PIN = 100_000
