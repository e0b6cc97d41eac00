"""Vocabularies of the match scorer and the résumé parser.

All tables here are fixed values: results depend on each word of them.
"""

from __future__ import annotations

SKILL_ALIASES: dict[str, str] = {
    "python": "python", "python3": "python", "python 3": "python",
    "fastapi": "fastapi", "fast api": "fastapi",
    "sql": "sql", "mysql": "mysql", "mysql database": "mysql",
    "postgresql": "postgresql", "postgres": "postgresql", "postgres db": "postgresql", "postgresql database": "postgresql", "postgressql": "postgresql",
    "mongodb": "mongodb", "mongo db": "mongodb", "mongo": "mongodb", "mongodb database": "mongodb",
    "redis": "redis",
    "javascript": "javascript", "java script": "javascript", "js": "javascript",
    "typescript": "typescript", "type script": "typescript", "ts": "typescript",
    "react": "react", "reactjs": "react", "react js": "react",
    "html": "html", "html5": "html", "css": "css", "css3": "css",
    "node": "node.js", "nodejs": "node.js", "node js": "node.js", "node.js": "node.js",
    "rest api": "rest api", "rest apis": "rest api", "restful api": "rest api", "restful apis": "rest api", "restful apis development": "rest api",
    "api": "api", "apis": "api", "api development": "api development", "api integration": "api integration",
    "git": "git", "github": "github", "source control": "version control", "version-control": "version control", "version control": "version control",
    "unit test": "unit testing", "unit tests": "unit testing", "unit testing": "unit testing",
    "automated testing": "automated testing", "test automation": "test automation", "integration testing": "integration testing", "pytest": "pytest",
    "docker": "docker", "kubernetes": "kubernetes", "k8s": "kubernetes",
    "aws": "aws", "amazon web services": "aws", "aws cloud": "aws", "azure": "azure",
    "gcp": "gcp", "google cloud": "gcp", "google cloud platform": "gcp",
    "machine learning": "machine learning", "machine-learning": "machine learning", "ml": "machine learning",
    "artificial intelligence": "artificial intelligence", "artificial-intelligence": "artificial intelligence", "ai": "artificial intelligence",
    "excel": "excel", "microsoft excel": "excel", "power bi": "power bi", "powerbi": "power bi", "tableau": "tableau", "pandas": "pandas", "numpy": "numpy",
    "java": "java", "c++": "c++", "c plus plus": "c++", "c#": "c#", "c sharp": "c#", "c": "c", "php": "php",
    "flask": "flask", "django": "django", "spring": "spring", "spring boot": "spring boot",
    "sqlalchemy": "sqlalchemy", "pydantic": "pydantic", "jwt": "jwt", "json web token": "jwt",
    "linux": "linux", "postman": "postman",
}
UNSAFE_ALIASES = ("c", "ai", "js", "ts", "it", "api", "mongo")
#: Names that a structured skill may have, by canonical skill.
SKILL_SYNONYMS: dict[str, tuple[str, ...]] = {
    "fastapi": ("fastapi", "fast api"),
    "postgresql": ("postgres", "postgresql", "postgres db", "postgres database", "postgresql db", "postgresql database"),
    "mongodb": ("mongodb", "mongo db", "mongo database"),
    "rest api": ("rest api", "rest apis", "restful api", "restful apis"),
    "node.js": ("node js", "nodejs", "node.js"),
    "aws": ("aws", "aws cloud", "amazon aws", "amazon web services", "amazon web services cloud"),
}
KEYWORD_ALIASES: dict[str, str] = {
    "bachelor degree": "bachelor's degree", "bachelors degree": "bachelor's degree", "master degree": "master's degree", "masters degree": "master's degree",
    "computer application": "computer applications", "computer science engineering": "computer science", "computer science and engineering": "computer science",
    "information technology engineering": "information technology", "information technology and engineering": "information technology",
    "rest apis": "rest api", "restful api": "rest api", "restful apis": "rest api", "problem-solving": "problem solving",
    "object-oriented programming": "object oriented programming", "data analytics": "data analytics", "data analysis": "data analysis",
}
PHRASE_VARIANTS: dict[str, str] = {
    "relational database": "relational database", "relational databases": "relational database",
    "database management": "database management", "database management systems": "database management", "database integration": "database integration",
    "application deployment": "application deployment", "deploy application": "application deployment", "deploy applications": "application deployment",
    "deploying application": "application deployment", "deploying applications": "application deployment",
    "deployed application": "application deployment", "deployed applications": "application deployment",
    "cloud deployment": "cloud deployment", "deploy to cloud": "cloud deployment", "deploying to cloud": "cloud deployment", "cloud deployments": "cloud deployment",
    "api development": "api development", "api developments": "api development", "api integration": "api integration",
    "software development": "software development", "software developments": "software development", "web development": "web development", "web developments": "web development", "backend development": "backend development",
    "unit testing": "unit testing", "automated testing": "automated testing", "integration testing": "integration testing",
    "problem solving": "problem solving", "problem-solving": "problem solving",
    "object oriented programming": "object oriented programming", "object-oriented programming": "object oriented programming",
    "performance optimization": "performance optimization", "microservices architecture": "microservices architecture",
    "secure api": "secure api", "secure apis": "secure api",
}
EDUCATION_LEVELS: dict[str, int] = {
    "phd": 5, "ph.d": 5, "doctorate": 5, "doctoral": 5,
    "master": 4, "masters": 4, "master's": 4, "master degree": 4, "master's degree": 4, "masters degree": 4, "mtech": 4, "m.tech": 4, "mca": 4, "msc": 4, "m.sc": 4, "mba": 4, "m.com": 4, "mcom": 4,
    "bachelor": 3, "bachelors": 3, "bachelor's": 3, "bachelor degree": 3, "bachelor's degree": 3, "bachelors degree": 3, "btech": 3, "b.tech": 3, "bsc": 3, "b.sc": 3, "bca": 3, "b.com": 3, "bcom": 3,
    "diploma": 2, "associate": 2,
    "intermediate": 1, "12th": 1, "higher secondary": 1,
    "10th": 0, "secondary": 0,
}
DEGREE_TERMS: tuple[tuple[int, tuple[str, ...]], ...] = (
    (5, ("phd", "doctorate", "doctoral")),
    (4, ("master's degree", "masters degree", "master degree", "master's", "masters", "master", "mtech", "mca", "msc", "mba", "mcom")),
    (3, ("bachelor's degree", "bachelors degree", "bachelor degree", "bachelor's", "bachelors", "bachelor", "btech", "bca", "bsc", "bcom")),
    (2, ("diploma", "associate degree", "associate")),
    (1, ("intermediate", "12th", "higher secondary")),
)
MANDATORY_MARKERS = ("required", "requirement", "must have", "must hold", "minimum", "mandatory", "essential")
PREFERRED_MARKERS = ("preferred", "preference", "prefer", "desired", "desirable", "nice to have", "is a plus", "a plus", "bonus", "optional", "advantageous")
STANDALONE_KEYWORDS = (
    "backend", "frontend", "fullstack", "full-stack", "api", "apis", "development", "testing", "debugging", "integration", "deployment",
    "authentication", "authorization", "security", "database", "databases", "architecture", "scalability", "performance", "optimization",
    "automation", "documentation", "maintenance", "monitoring", "troubleshooting", "implementation", "validation",
    "agile", "scrum", "sprint", "microservices", "services", "endpoints", "unit", "pytest", "collaboration", "teamwork", "code", "review",
)
GENERIC_KEYWORDS = (
    "candidate", "candidates", "applicant", "applicants", "experience", "experiences", "skill", "skills", "service", "services", "system", "systems",
    "application", "applications", "software", "technology", "technologies", "database", "databases", "development", "developments", "developer", "developers",
    "team", "teams", "work", "works", "role", "roles", "job", "jobs", "position", "positions", "company", "companies", "environment", "environments",
    "solution", "solutions", "project", "projects", "responsibility", "responsibilities", "requirement", "requirements", "qualification", "qualifications",
)
FIELD_GROUPS: tuple[tuple[str, ...], ...] = (
    ("computer applications", "computer application", "bca", "bachelor of computer applications", "mca", "master of computer applications"),
    ("computer science", "computer science engineering", "computer science and engineering", "cse", "btech computer science", "b.tech computer science"),
    ("information technology", "information technology engineering", "information technology and engineering", "it degree"),
    ("software engineering", "software engineering and development"),
    ("information systems", "information system"),
    ("electronics", "electronics and communication", "electonics and communications", "electronical and electronics", "electronics and communication engineering", "ece"),
    ("commerce", "commerce and computer applications", "b.com", "bcom", "m.com", "mcom"),
    ("mechanical engineering", "mechanical"),
    ("civil engineering", "civil"),
    ("business administration", "business management", "management", "mba"),
)
IMPORTANT_PHRASES = (
    "software engineering", "software development", "web development", "backend development", "backend developer", "frontend development", "frontend developer",
    "full stack", "full stack development", "full stack developer", "rest api", "rest apis", "restful api", "restful apis", "api development",
    "machine learning", "artificial intelligence", "data analysis", "data analytics", "problem solving", "problem-solving",
    "object oriented programming", "object-oriented programming", "database management", "relational database", "software development lifecycle",
    "version control", "unit testing", "test automation", "cloud computing", "continuous integration", "continuous deployment", "agile methodology", "agile development",
)
CONTROLLED_PHRASES = (
    "backend developer", "backend development", "software development", "web development", "api development", "api integration", "rest api", "rest api development",
    "unit testing", "automated testing", "integration testing", "version control", "database design", "database management", "object oriented programming",
    "problem solving", "debugging", "code review", "agile development", "software engineering", "backend engineering", "web application development",
    "application development", "application programming", "database integration", "cloud deployment", "application deployment", "authentication", "authorization",
    "secure api", "scalable applications", "performance optimization", "microservices architecture",
)

PARSER_SKILLS: dict[str, str] = {
    "python": "Python", "java": "Java", "c++": "C++", "c#": "C#", "javascript": "JavaScript", "typescript": "TypeScript",
    "sql": "SQL", "mysql": "MySQL", "postgresql": "PostgreSQL", "postgres": "PostgreSQL", "mongodb": "MongoDB", "oracle": "Oracle", "sqlite": "SQLite",
    "fastapi": "FastAPI", "django": "Django", "flask": "Flask", "spring boot": "Spring Boot",
    "rest api": "REST API", "rest apis": "REST API", "restful api": "REST API", "restful apis": "REST API", "api development": "API Development",
    "crud": "CRUD", "crud operations": "CRUD", "sqlalchemy": "SQLAlchemy", "pydantic": "Pydantic", "entity framework": "Entity Framework", "hibernate": "Hibernate",
    "jwt": "JWT", "jwt authentication": "JWT", "oauth": "OAuth", "oauth2": "OAuth",
    "rbac": "RBAC", "role based access control": "RBAC", "role-based access control": "RBAC",
    "oop": "OOP", "object oriented programming": "OOP", "object-oriented programming": "OOP",
    "data structures": "Data Structures", "data structure": "Data Structures", "algorithms": "Algorithms", "algorithm": "Algorithms", "database design": "Database Design",
    "git": "Git", "github": "GitHub", "gitlab": "GitLab", "postman": "Postman", "vs code": "VS Code", "visual studio code": "VS Code",
    "docker": "Docker", "kubernetes": "Kubernetes", "aws": "AWS", "amazon web services": "AWS", "azure": "Azure", "microsoft azure": "Azure",
    "html": "HTML", "html5": "HTML", "css": "CSS", "css3": "CSS", "react": "React", "react.js": "React", "node.js": "Node.js", "nodejs": "Node.js",
    "pandas": "Pandas", "numpy": "NumPy", "machine learning": "Machine Learning", "artificial intelligence": "Artificial Intelligence", "generative ai": "Generative AI",
    "chatgpt": "ChatGPT", "google gemini": "Google Gemini", "gemini": "Google Gemini", "servicenow": "ServiceNow", "service now": "ServiceNow",
}
AI_TOOLS: dict[str, str] = {
    "chatgpt": "ChatGPT", "openai chatgpt": "ChatGPT", "google gemini": "Google Gemini", "gemini": "Google Gemini",
    "github copilot": "GitHub Copilot", "copilot": "GitHub Copilot", "claude": "Claude", "anthropic claude": "Claude",
}
SECTIONS: dict[str, tuple[str, ...]] = {
    "summary": ("summary", "professional summary", "profile", "professional profile", "objective", "career objective"),
    "skills": ("skills", "technical skills", "technical skill", "key skills", "core skills", "technical competencies"),
    "experience": ("experience", "work experience", "professional experience", "employment history", "internship", "internships", "work history"),
    "projects": ("projects", "project", "personal projects", "academic projects", "key projects", "technical projects"),
    "education": ("education", "academic qualification", "academic qualifications", "qualifications", "educational background"),
    "certifications": ("certification", "certifications", "certificates", "licenses and certifications"),
    "languages": ("language", "languages", "known languages"),
}
