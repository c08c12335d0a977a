"""Patterns, labels and lookup tables whose contents decide results. Patterns are in the common subset of the
regex dialects used, with ``\\b`` meaning an ASCII word boundary."""

# fixed values: industry rules, in order
INDUSTRY = [
    ("healthcare", r"\b(nurse|nursing|rn|physician|doctor|medical|clinical|pharmac|dental|dentist|therapist|caregiver|health ?care|hospital|paramedic|psw|patient)\b"),
    ("legal", r"\b(lawyer|attorney|paralegal|legal|counsel|litigation|compliance officer)\b"),
    ("education", r"\b(teacher|professor|instructor|tutor|lecturer|education|school|early childhood|principal|faculty)\b"),
    ("trades_construction", r"\b(electrician|plumber|welder|carpenter|hvac|millwright|construction|mechanic|technician|apprentice|roofer|foreman|journeyman|heavy equipment)\b"),
    ("manufacturing_logistics", r"\b(warehouse|forklift|driver|trucker|logistics|supply chain|manufactur|machine operator|assembly|shipping|receiving|dispatcher|production)\b"),
    ("hospitality_tourism", r"\b(chef|cook|server|bartender|barista|hotel|restaurant|hospitality|front desk|housekeep|tourism|kitchen|catering)\b"),
    ("customer_service", r"\b(customer service|customer support|call cent(er|re)|help ?desk|client service|care representative|support agent)\b"),
    ("finance_accounting", r"\b(accountant|accounting|bookkeep|auditor|finance|financial|analyst|banking|teller|actuar|payroll|tax)\b"),
    ("sales_marketing", r"\b(sales|marketing|account executive|business development|seo|brand|copywriter|social media|retail associate|merchandis)\b"),
    ("technology", r"\b(software|developer|engineer|devops|cloud|data scientist|data engineer|machine learning|frontend|backend|full[- ]?stack|sre|cyber|security analyst|it support|qa|programmer|product manager|ux|ui designer|sysadmin|network)\b"),
]

# fixed values: kinds of work and employment, in order of precedence
HYBRID = r"\bhybrid\b"
REMOTE = r"\b(remote|work from home|wfh|telecommute|distributed)\b"
EMPLOYMENT = [
    ("internship", r"\b(intern|internship|co-?op|practicum)\b"),
    ("part-time", r"\b(part[- ]?time)\b"),
    ("contract", r"\b(contract|contractor|freelance|fixed[- ]term|consultant)\b"),
    ("temporary", r"\b(temp|temporary|seasonal|casual)\b"),
]

# fixed values: seniority by title, in order
SENIORITY = [
    ("executive", r"\b(chief|cxo|ciso|cto|cfo|ceo|vp|vice president|president|head of|director)\b"),
    ("manager", r"\b(manager|supervisor|superintendent)\b"),
    ("lead", r"\b(lead|principal|staff|architect|foreman)\b"),
    ("senior", r"\b(senior|sr\.?|iii|journeyman)\b"),
    ("entry", r"\b(intern|junior|jr\.?|entry|graduate|new grad|apprentice|trainee|associate|co-?op|i\b)"),
    ("mid", r"\b(ii|intermediate|mid)\b"),
]
YEARS = r"(\d{1,2})\+?\s*(?:-\s*\d{1,2}\s*)?years?"

# fixed values: work authorisation, in order
WORK_AUTH = [
    ("citizenship", r"\b(canadian|u\.?s\.?|us|american) citizen(ship)?\b[^.]{0,40}\b(required|only|must)|\bmust be an? (canadian|u\.?s\.?|us) citizen|\bcitizens? only\b"),
    ("pr-or-citizen", r"\b(citizen|citizenship) or (a )?permanent resident|\bpermanent residen(t|cy)[^.]{0,30}\b(required|only|must)|\bmust be a permanent resident"),
    ("clearance", r"\b(security|secret|top secret|ts\/sci|government) clearance\b|\breliability status\b|\benhanced reliability\b|\bpublic trust\b|\bnato secret\b"),
    ("no-sponsorship", r"\b(no|not|unable to|cannot|can ?not|will not|won't|does not|do not)\b[^.]{0,25}\bsponsor|\bsponsorship (is )?not (available|provided|offered)|\bwithout (the need for )?(visa )?sponsorship|\bno lmia\b"),
    ("sponsorship", r"\b(visa|work permit|lmia|h-?1b) sponsorship (is )?(available|provided|offered)|\bwill (provide |offer )?sponsor|\blmia (available|approved|supported)\b"),
    ("must-be-eligible", r"\b(legally )?(eligible|entitled|authori[sz]ed) to work in (canada|the (united states|us|u\.s\.))\b"),
]

# fixed values: lexicons of certifications, tools and skills, in order; a plain string is its own pattern
CERTIFICATIONS = [
    "CISSP", "CISM", "CISA", "CEH", "OSCP", ("GIAC", "GIAC|GSEC|GCIH|GPEN|GCIA"), ("CompTIA Security+", r"Security\+|CompTIA Security"), "CCSP", "CRISC", "CCNA", "CCNP",
    ("AWS Certified", "AWS Certified|AWS Solutions Architect"), ("Azure Certified", r"AZ-\d{3}|Azure Certified|AZ-500|SC-200"), "PMP", "ITIL", "CPA", "CFA", "CMA",
    ("RN license", "RN|Registered Nurse"), "Red Seal", ("First Aid / CPR", "First Aid|CPR"), ("Class 1 / Class 5 Licence", "Class [1-5] (licen[cs]e)?"),
    ("Forklift", r"forklift (ticket|certif\w+|licen[cs]e)"), "WHMIS", ("SmartServe / Food Handler", "SmartServe|Food ?Handler"), ("Teaching Certificate", "OCT|BCTC|teaching (certificate|licen[cs]e)"),
    ("Six Sigma", "Six Sigma|Lean Six Sigma"), ("CHRP / CPHR", "CHRP|CPHR"), ("LSAT / Bar admission", "Bar admission|called to the bar"),
]
TOOLS = [
    "Splunk", "Wireshark", "Nessus", "CrowdStrike", "Palo Alto", "Okta", "SentinelOne", ("Microsoft Sentinel", "Sentinel"), "AWS", "Azure", ("GCP", "GCP|Google Cloud"), ("Kubernetes", "Kubernetes|k8s"),
    "Docker", "Terraform", "Ansible", "Jenkins", ("Git", "Git|GitHub|GitLab"), "Linux", "Windows Server", "Active Directory", "ServiceNow", "Salesforce", "SAP", "Workday", "Oracle",
    ("Excel", "Excel|Microsoft Excel"), ("Power BI", "Power ?BI"), "Tableau", "QuickBooks", ("Epic", "Epic (EMR|EHR|systems)?"), "AutoCAD", "Jira", "Figma", "Photoshop",
    ("Microsoft 365", "Microsoft 365|Office 365|M365"), "Zendesk", "HubSpot", "Shopify", "Kafka", ("PostgreSQL", "PostgreSQL|Postgres"), "MySQL", "MongoDB",
]
SKILLS = [
    "Python", ("JavaScript", "JavaScript|JS"), "TypeScript", "Java", "C#", ("C++", r"C\+\+"), ("Go", "Golang"), "SQL", "React", ("Node.js", r"Node(\.js)?"), (".NET", r"\.NET"),
    ("Incident Response", "incident response"), ("Threat Hunting", "threat hunting"), ("Penetration Testing", r"penetration test\w*|pentest\w*"), "SIEM", ("Vulnerability Management", "vulnerability management"),
    ("Risk Assessment", "risk assessment"), ("Compliance", "compliance|SOC ?2|ISO ?27001|NIST|PCI"), ("Cloud Security", "cloud security"), ("Network Security", "network security|firewall"),
    ("Machine Learning", "machine learning|ML"), ("Data Analysis", "data analysis|analytics"), ("Project Management", "project management"), ("Customer Service", "customer service"),
    ("Communication", "communication skills|written and verbal"), ("Leadership", "leadership|team lead"), ("Bilingual (EN/FR)", "bilingual|French and English|English and French"),
    ("Patient Care", "patient care"), ("Budgeting & Forecasting", r"budget\w*|forecast\w*"), ("Sales", "B2B sales|sales experience|business development"), ("Welding", "welding"),
    ("Electrical Installation", r"electrical install\w*|wiring"), ("Inventory / Warehouse", "inventory|warehouse"), ("Food Safety", "food safety"), ("Curriculum Design", "curriculum"),
]

# fixed values: degrees, highest first, and soft skills matched loosely
EDUCATION = [
    ("PhD", r"\b(ph\.?\s?d|doctorate)\b", 4),
    ("Master's degree", r"\b(master'?s?|m\.?\s?sc|mba|m\.?\s?eng)\b", 3),
    ("Bachelor's degree", r"\b(bachelor'?s?|b\.?\s?sc|b\.?\s?eng|b\.?\s?tech|b\.?\s?a\.?|undergraduate degree|university degree|degree in)\b", 2),
    ("College diploma", r"\b(diploma|college|associate'?s? degree|post-?graduate certificate|certificate program)\b", 1),
]
SOFT_SKILLS = {
    "Communication": r"\bcommunicat\w*",
    "Leadership": r"\b(leadership|led|lead(ing)?|mentor\w*|supervis\w*)\b",
    "Customer Service": r"\b(customer|client)s?\s+(service|support|care|experience)\b",
    "Bilingual (EN/FR)": r"\b(bilingual|french)\b",
}

# fixed values: hosts, their portals, and whether a portal is the employer's own
PORTALS = [
    (r"(^|\.)indeed\.", "Indeed", False), (r"(^|\.)linkedin\.com$", "LinkedIn", False), (r"(^|\.)glassdoor\.", "Glassdoor", False), (r"(^|\.)ziprecruiter\.", "ZipRecruiter", False),
    (r"(^|\.)monster\.", "Monster", False), (r"(^|\.)jobbank\.gc\.ca$", "Job Bank (Canada)", False), (r"(^|\.)talent\.com$", "Talent.com", False), (r"(^|\.)jooble\.org$", "Jooble", False),
    (r"(^|\.)adzuna\.", "Adzuna", False), (r"(^|\.)simplyhired\.", "SimplyHired", False), (r"(^|\.)eluta\.ca$", "Eluta", False), (r"(^|\.)jobillico\.com$", "Jobillico", False),
    (r"(^|\.)workbc\.ca$", "WorkBC", False), (r"(^|\.)usajobs\.gov$", "USAJOBS", False), (r"(^|\.)dice\.com$", "Dice", False), (r"(^|\.)careerbuilder\.com$", "CareerBuilder", False),
    (r"(^|\.)wellfound\.com$", "Wellfound", False), (r"(^|\.)remotive\.com$", "Remotive", False), (r"(^|\.)himalayas\.app$", "Himalayas", False),
    (r"(^|\.)greenhouse\.io$", "Company site (Greenhouse)", True), (r"(^|\.)lever\.co$", "Company site (Lever)", True), (r"(^|\.)ashbyhq\.com$", "Company site (Ashby)", True),
    (r"(^|\.)smartrecruiters\.com$", "Company site (SmartRecruiters)", True), (r"(^|\.)myworkdayjobs\.com$", "Company site (Workday)", True), (r"(^|\.)icims\.com$", "Company site (iCIMS)", True),
    (r"(^|\.)taleo\.net$", "Company site (Taleo)", True), (r"(^|\.)successfactors\.(com|eu)$", "Company site (SuccessFactors)", True), (r"(^|\.)bamboohr\.com$", "Company site (BambooHR)", True),
    (r"(^|\.)workable\.com$", "Company site (Workable)", True), (r"(^|\.)jobvite\.com$", "Company site (Jobvite)", True), (r"(^|\.)recruitee\.com$", "Company site (Recruitee)", True),
]
SOURCE_PORTALS = {
    "canada_job_bank": "Job Bank (Canada)", "usajobs": "USAJOBS", "adzuna": "Adzuna", "jooble": "Jooble", "jsearch": "Original posting", "greenhouse": "Company site (Greenhouse)",
    "lever": "Company site (Lever)", "ashby": "Company site (Ashby)", "smartrecruiters": "Company site (SmartRecruiters)", "workable": "Company site (Workable)",
    "recruitee": "Company site (Recruitee)", "remotive": "Remotive", "himalayas": "Himalayas", "deep_link": "Original posting",
}

# fixed values: regions by code
PROVINCES = {
    "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland and Labrador", "NS": "Nova Scotia", "NT": "Northwest Territories", "NU": "Nunavut",
    "ON": "Ontario", "PE": "Prince Edward Island", "QC": "Quebec", "SK": "Saskatchewan", "YT": "Yukon",
}
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida",
    "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island",
    "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin",
    "WY": "Wyoming",
}

# fixed values: words of titles and companies
TITLE_WORDS = {
    "sr": "senior", "snr": "senior", "jr": "junior", "jnr": "junior", "mgr": "manager", "assoc": "associate", "asst": "assistant", "admin": "administrator", "engr": "engineer", "eng": "engineer",
    "dev": "developer", "tech": "technician", "spec": "specialist", "coord": "coordinator", "rep": "representative", "ii": "2", "iii": "3", "iv": "4", "l1": "1", "l2": "2", "l3": "3",
}
TITLE_NOISE = ["remote", "hybrid", "onsite", "on-site", "wfh", "fulltime", "parttime", "permanent", "contract", "temporary", "urgent", "hiring", "new", "job", "position", "the"]
COMPANY_SUFFIXES = r"\b(inc|incorporated|llc|ltd|limited|corp|corporation|co|company|lp|llp|plc|gmbh|canada|usa|us)\b\.?"

# fixed values: exchange rate, hours of a year, sane range of a yearly salary
USD_TO_CAD, HOURS, LOWEST, HIGHEST = 1.37, 2080, 5000, 2_000_000

# fixed values: what to search for in an industry if nothing is asked
INDUSTRY_KEYWORDS = {
    "technology": "software OR developer OR IT", "healthcare": "nurse OR healthcare", "trades_construction": "electrician OR construction OR trades", "finance_accounting": "accountant OR finance",
    "sales_marketing": "sales OR marketing", "education": "teacher OR education", "hospitality_tourism": "hospitality OR restaurant", "customer_service": "customer service", "legal": "legal OR paralegal",
    "manufacturing_logistics": "warehouse OR logistics OR manufacturing",
}

# fixed values: years asked for beside experience, and years claimed in a resume
REQUIRED_YEARS = r"(\d{1,2})\s*\+?\s*(?:-|–|to)?\s*(?:\d{1,2})?\s*\+?\s*(?:years?|yrs?)\b[^.\n]{0,40}?(?:experience|exp\b|in |of |working|hands)"
CLAIMED_YEARS = r"(\d{1,2})\s*\+?\s*years?(?:\s+of)?\s+(?:professional\s+|hands-on\s+|work\s+|industry\s+)?experience"
SCHOOLING = r"\b(college|university|school|bachelor|master|diploma|degree|b\.?\s?eng|b\.?\s?sc|certificate program|student)\b"
DATED_SPAN = r"((?:19|20)\d{2}\s*(?:-|–|—|to)\s*(?:(?:19|20)\d{2}|present|current|now|today))"

# fixed values: what a parser of resumes looks for: patterns in the text, patterns of headings, bullets and numbers
RESUME_EMAIL, RESUME_PHONE = r"[\w.+-]+@[\w-]+\.[\w.]+", r"\+?\d[\d\s().-]{8,}\d"
RESUME_HEADINGS = {
    "experience": r"^(work |professional |relevant )?(experience|employment|work history)\b", "education": r"^(education|academic|qualifications)\b",
    "skills": r"^(technical |core |key )?(skills|competencies|technologies|tools)\b",
}
RESUME_BULLET, RESUME_NUMBER = r"^[-•*▪◦●]\s?", r"\d+\s?%|\$\s?\d|\b\d{2,}\b"

# fixed values: words of a title that say its level, and where terms end
TITLE_LEVELS = ["senior", "junior", "lead", "principal", "staff", "intern", "1", "2", "3", "4"]
TERM_BREAKS = r"[,.;:!?()\[\]\n\r•|/]+|\s[-–—]\s"

# fixed values: how many words a posting is summed up in, and which aren't counted as they are scored as soft skills
KEYWORDS = 15
SAID_ANYWAY = ["communication", "leadership", "customer service", "bilingual"]

# fixed values: the sentence and the headings of a run's summary
SUMMARY = "**%d** jobs live (%d Canada, %d USA). %d fetched this run."
SOURCE_TABLE = "| Source | Jobs this run | Status |"
KEYWORD_TABLE = "| Keyword | Jobs on site | Canada | Searches | Status |"
