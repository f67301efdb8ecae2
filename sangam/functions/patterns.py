"""Wordings of the emergency domain. Patterns, confidences, ranks and word lists that results depend on."""

# Incident type -> (rank among equals, [(pattern, confidence)])
INCIDENT_TYPES = {
    "flood": (1, [(r"\bflood(?:ing|ed|water|s)?\b", 90), (r"\bwater\s+(?:level|rising|entered|depth)\b", 80), (r"\bsubmerge[ds]?\b", 85), (r"\bwaterlog(?:ged|ging)?\b", 85), (r"\bdrain\s+overflow\b", 75), (r"पानी\s*भर", 85), (r"पानी.*बढ़\s*रहा", 80), (r"डूब", 80), (r"\bpaani\s+bhar\b", 85), (r"\bpaani.*(?:tez|badh)\b", 80), (r"\bdoob\b", 75)]),
    "rescue_needed": (5, [(r"\brescue\b", 90), (r"\btrapped\b", 90), (r"\b(?:people|persons?|family|families|someone|residents?)\s+(?:is|are|was|were|got)?\s*stuck\b", 85), (r"\bscreaming\s+for\s+help\b", 95), (r"\bbachao\b", 90), (r"\blog\s+phase\b", 85), (r"परिवार.*फंस|लोग.*फंस|फंसा\s+है", 85), (r"बचाओ", 90), (r"मदद\s*भेजो", 85)]),
    "road_blocked": (3, [(r"\broads?\s+(?:is|are|was|were)?\s*(?:completely|totally|partially)?\s*blocked\b", 90), (r"\bvehicles?\s+(?:cannot|can't)\s+pass\b", 85), (r"\btraffic\s+(?:at\s+)?standstill\b", 85), (r"\bvehicles?\s+(?:is|are|was|were|got)?\s*stuck\b", 80), (r"\btraffic\s+disruption\b", 75), (r"सड़क\s*बंद", 85), (r"गाड़ियाँ\s*फंसी", 80), (r"\broad\s+block\b", 85), (r"\bgaadi\s+phase\b", 75)]),
    "power_outage": (4, [(r"\bpower\s+(?:cut|outage|failure)\b", 90), (r"\btransformer\s+(?:submerge|flood)\w*\b", 85), (r"\bwithout\s+electricity\b", 85), (r"\bwires?\s+hanging\b", 75), (r"बिजली\s*गुल", 90), (r"ट्रांसफॉर्मर.*डूब", 85), (r"\bbijli\s+nahi\b", 85)]),
    "structural_damage": (4, [(r"\b(?:boundary\s+)?wall\s+(?:showing|leaning|tilt|crack|collaps)\w*\b", 90), (r"\brisk\s+of\s+collapse\b", 90), (r"\bsignificant\s+cracks\b", 90), (r"\bstructur(?:e|al)\s+(?:damage|risk|concern)\b", 80), (r"\bdamaged\s+boundary\s+wall\b", 90), (r"\bdeewar\s+tedi\b", 90), (r"\bgir\s+jayegi\b", 80), (r"\btooti\b", 75)]),
    "waterlogging": (2, [(r"\bwaterlog(?:ged|ging)\b", 85), (r"\bwading\s+through\s+water\b", 70)]),
}
# Severity levels, most severe first
SEVERITY = {
    "critical": [(r"\bcritical\b", 90), (r"\bvery\s+dangerous\b", 85), (r"\bvery\s+critical\b", 90), (r"खतरनाक\s*स्थिति", 85), (r"\bkhatarnak\b", 80)],
    "severe": [(r"\bsevere\b", 85), (r"\bcompletely\s+(?:blocked|flooded|submerged)\b", 80), (r"\brisk\s+of\s+collapse\b", 80), (r"\bworsening\b", 70), (r"\bbahut\s+tez\b", 75)],
    "moderate": [(r"\bmoderate\b", 80)],
    "minor": [(r"\bminor\s+(?:flood|damage)\w*\b", 80), (r"\bno\s+immediate\s+danger\b", 75), (r"\bcan\s+pass\s+slowly\b", 70)],
}
# Fixed values
VULNERABLE = [(r"\b(?:child|children|kids?|infant|baby|babies)\b", 90), (r"\b(?:elderly|old\s+(?:man|woman|people|persons?))\b", 90), (r"\b(?:disabled|handicapped|pregnant)\b", 85), (r"बच्चे", 90), (r"बुज़ुर्ग|बूढ़", 90), (r"\bbachch\w*\b", 80), (r"\bbuzu?rg\b", 80)]
TRAPPED = [(r"\btrapped\b", 90), (r"\b(?:people|persons?|family|families|someone|residents?)\s+(?:is|are|was|were|got)?\s*stuck\b", 85), (r"\brescue\s+(?:needed|required|operation)\b", 90), (r"\bneed\s+rescue\b", 90), (r"\bscreaming\s+for\s+help\b", 95), (r"परिवार.*फंस|लोग.*फंस|फंसा\s+है|फंसे\s+हैं", 85), (r"बचाओ", 90), (r"मदद\s*भेजो", 85), (r"\blog\s+phase\b|\bphase\s+hain\b", 85), (r"\bphaas\b", 85), (r"\bbachao\b", 90)]
#: stranded counts unless what follows are vehicles
STRANDED, STRANDED_NOT = (r"\bstranded\b", 80), r"\bstranded\s+(?:vehicles?|cars?|traffic)"
URGENT = [(r"\burgent(?:ly)?\b", 90), (r"\bemergency\b", 85), (r"\brising\s+(?:rapidly|fast)\b", 85), (r"\bscreaming\s+for\s+help\b", 90), (r"\bneed\s+rescue\b", 90), (r"\brecommend\s+evacuation\b", 90), (r"\bevacuat(?:e|ion)\b", 85), (r"तुरंत\s*मदद", 90), (r"तुरंत", 80), (r"\bbachao\b", 90), (r"\bturant\b", 85), (r"\bpaani\s+bahut\s+tez\b", 80)]
#: immediate counts unless denied or followed by danger
IMMEDIATE, IMMEDIATE_NOT = [(r"\bimmediate\s+rescue\b", 95), (r"\bimmediatel?y?\b", 90)], r"\bno\s+immediate\w*|\bimmediately\s+danger|\bimmediate\s+danger"
EXPLICIT = [(r"\b(?:on[- ]ground|on-site)\s+assessment\b", 95), (r"\bconfirmed\b", 90), (r"\bi\s+(?:can\s+)?see\b", 85), (r"\binspected\b", 90), (r"\bobserved\b", 85), (r"\bassessment\b", 85), (r"\bfield_worker\b", 80)]
INFERRED = [(r"\breport(?:s|ed)\s+(?:of|that)\b", 80), (r"\bsomeone\s+said\b", 85), (r"\breportedly\b", 80), (r"\bsuspected\b", 75), (r"\bhas\s+been\s+informed\b", 70)]
PEOPLE = [
    (r"\b(\d+)\s+(?:people|persons?)\s+trapped\b", "trapped"), (r"\b(\d+)\s+(?:people|persons?|members?)\s+(?:including|trapped|stuck)\b", "trapped"), (r"\bfamily\s+of\s+(\d+)\s+members?\b", "trapped"),
    (r"\b(\d+)\s+(?:resident|people|person)s?\s+(?:in\s+(?:immediate\s+)?vicinity|nearby)\b", "nearby"), (r"\babout\s+(\d+)\s+residents?\b", "affected"), (r"\bapproximately\s+(\d+)\s+residents?\b", "nearby"),
    (r"\b(\d+)\s+(?:families|households?)\s+affected\b", "affected"), (r"\b(\d+)\s+residents?\s+(?:is|are|was|were)?\s*affected\b", "affected"), (r"\b(\d+)\s+log\s+(?:phase|phaas)\b", "trapped"), (r"\b(?:lagbhag|karib)\s+(\d+)\s+log\b", "nearby"),
]
PEOPLE_RANGES = [(r"\b(\d+)\s+to\s+(\d+)\s+(?:house|home|famil)\w*\b", "affected"), (r"\b(\d+)\s*-\s*(\d+)\s+(?:people|persons?|residents?)\b", "affected"), (r"\b(\d+)\s*-\s*(\d+)\s+gaadi\b", "affected"), (r"\b(\d+)\s*-\s*(\d+)\s+log\b", "nearby")]
ROMANISED = "paani barish bachao sadak bijli madad mein hai hain nahi bahut log ghar wajah se pe ke ka ki ko tez aao phase phaas doob bhar mushkil khatra khatarnak tedi tooti mohalla chowk gaadi deewar".split()
SOURCES = {"whatsapp": "whatsapp", "sms": "sms", "web": "web", "field_worker": "field_worker", "whats app": "whatsapp", "wa": "whatsapp", "text": "sms", "website": "web", "online": "web", "field": "field_worker", "fieldworker": "field_worker", "field worker": "field_worker", "fw": "field_worker"}
DAMAGED = r"\b(?:collapsed?|leaning|tilted?|showing\s+(?:significant\s+)?cracks?|crack(?:ed|ing)?|risk\s+of\s+collapse|tooti|tedi|gir\s+jayegi|damaged?\s+boundary\s+wall)\b"
INTACT = r"\b(?:fully\s+intact|appears\s+fully\s+intact|intact|no\s+visible\s+(?:cracks?|damage)|structure\s+appears\s+stable|building\s+structure\s+appears\s+stable|no\s+structural\s+damage)\b"
BLOCKED = r"\b(?:completely\s+blocked|road\s+(?:is\s+)?(?:completely\s+)?blocked|traffic\s+at\s+standstill|vehicles?\s+(?:cannot|can't)\s+pass|सड़क\s*बंद|road\s+block(?:ed)?|sadak\s+band)\b"
PASSABLE = r"\b(?:vehicles?\s+can\s+pass(?:\s+slowly)?|vehicles?\s+passing\s+slowly|slowly\s+passable|can\s+pass\s+slowly|passable\s+on\s+side\s+road)\b"
# Base severity by type, severity of words, related and incompatible types
TYPE_BASE = {"rescue_needed": 85, "flood": 65, "structural_damage": 60, "waterlogging": 40, "road_blocked": 35, "power_outage": 30}
WORD_SEVERITY = {"critical": 90, "severe": 70, "moderate": 45, "minor": 20}
RELATED_TYPES = [("flood", "waterlogging"), ("flood", "rescue_needed"), ("waterlogging", "road_blocked"), ("power_outage", "structural_damage"), ("flood", "structural_damage")]
INCOMPATIBLE_TYPES = [("drought", "flood"), ("wildfire", "flood"), ("drought", "waterlogging")]
FAMILIES = [(r"\b(?:approximately|about|around)?\s*(\d+)\s+families\s+affected\b", "affected")]
# Evidence that counts as of vulnerable or trapped people when severity is assessed; W is a letter, digit or _
VULNERABLE_SEEN = r"(?:child|children|kids?|infant|baby|babies|elderly|old\s+man|old\s+woman|old\s+people|old\s+person|disabled|handicapped|pregnant|बच्चे|बुज़ुर्ग|बूढ़|bachch\w*|buzu?rg)"
TRAPPED_SEEN = r"(?:trapped|stuck|stranded|phaas|log\s+phase|phase\s+hain|फंस)"
# Place phrases (W stands for letters, digits and _ of any script) and parts of known places
PLACES = [
    r"\bnear\s+([W\s]+?)(?:\s+area|\s+thana|\s+police\s+station|\.|,|$)", r"\bat\s+([W\s]+?)(?:\s+area|\s+intersection|\.|,|$)",
    r"\bin\s+((?:Civil Lines|Kotwali|Bilaspur Chowk|Naya Mohalla)(?:\s+area)?)", r"(सिविल\s*लाइन्स|कोतवाली|बिलासपुर\s*चौक|नया\s*मोहल्ला|नया\s*मोहल्ले)",
    r"([W\s]+?)\s*(?:में|पर|के\s+पास)", r"\b(Civil Lines|Kotwali|Bilaspur Chowk|Naya Mohall[ae])\b", r"([W\s]+?)\s+(?:mein|pe|ke\s+paas)",
]
PLACE_PARTS = ["civil lines", "civil line", "kotwali", "bilaspur chowk", "bilaspur chauk", "naya mohalla", "naya mohalle", "rampur", "community center", "सिविल लाइन्स", "कोतवाली", "बिलासपुर चौक", "नया मोहल्ला", "नया मोहल्ले"]
# Zones by parts of a place name
ZONES = ["civil", "kotwali", "bilaspur", "naya"]
