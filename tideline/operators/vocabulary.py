"""Fixed values of the data model."""

# They must equal those of the data.
EVENT_TYPES = ["created", "started", "paused", "resumed", "completed", "forgotten", "cancelled"]
OPENING, CLOSING = ["created", "started", "resumed"], ["paused", "completed", "forgotten", "cancelled"]
TERMINAL = ["completed", "forgotten", "cancelled"]
INTERRUPTION_TYPES = ["phone", "social_media", "message", "call", "search", "person", "food", "other"]
LOCATION_TYPES = ["HOME", "WORK", "GYM", "COMMUTE", "STUDY", "OTHER"]
LATE_HOUR = 21
ANOMALY_HOURS = 12
IDLE_MINUTES, SWITCH_SECONDS = 30, 300

# Aliases of task categories, as data may spell them.
CATEGORY_ALIASES = {
    "deep work": "deep_work",
    "deep-work": "deep_work",
    "deepwork": "deep_work",
    "emails": "email",
    "e-mail": "email",
    "meetings": "meeting",
    "admin work": "admin",
    "administration": "admin",
    "study": "learning",
    "studying": "learning",
    "chore": "chores",
    "housework": "chores",
    "plan": "planning",
    "plans": "planning",
    "create": "creative",
    "creativity": "creative",
}
