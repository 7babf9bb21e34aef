"""Values that must equal the original tool's for identical results.

FIXED VALUES — kept together, plain text, in their natural order. Nothing
else in the package restates them.
"""

# ---------------------------------------------------------------- FIXED VALUES
# Speech-model catalogue: name, repository, size in GB, description.
SPEECH_MODELS = [
    ("tiny", "Systran/faster-whisper-tiny", 0.075, "Fastest, least accurate"),
    ("base", "Systran/faster-whisper-base", 0.145, "Good speed/accuracy balance"),
    ("small", "Systran/faster-whisper-small", 0.483, "Better accuracy"),
    ("medium", "Systran/faster-whisper-medium", 1.53, "High accuracy"),
    ("large-v3", "Systran/faster-whisper-large-v3", 3.09, "Best accuracy (recommended)"),
]
# Free disk must be at least the download size plus this buffer (GB).
DISK_BUFFER_GB = 1.0

# Supported names per pluggable stage.
VIDEO_PLATFORMS = ["youtube"]
MODEL_PLATFORMS = ["huggingface"]
SPEECH_BACKENDS = ["whisper"]
LLM_BACKENDS = ["openai", "anthropic", "ollama"]
IMAGE_BACKENDS = ["diffusers", "openai", "stability"]

# Default model per text backend and per image backend.
LLM_DEFAULT_MODEL = {"openai": "gpt-4o-mini", "anthropic": "claude-3-5-sonnet-20241022", "ollama": "llama3"}
LLM_DEFAULT_TEMPERATURE = 0.7
LLM_DEFAULT_MAX_TOKENS = {"openai": 4000, "anthropic": 4000}   # the local backend sends none
IMAGE_DEFAULT_MODEL = {"diffusers": "stabilityai/stable-diffusion-xl-base-1.0", "openai": "dall-e-3",
                       "stability": "sd3-large"}

# Default negative prompt per image backend (the hosted DALL-E backend has none).
NEGATIVE_PROMPT = {
    "diffusers": "blurry, bad quality, distorted, ugly, low resolution, artifacts",
    "stability": "blurry, bad quality, distorted, ugly, low resolution",
}
# Default settings per image backend.
DIFFUSERS_STEPS = 30
DIFFUSERS_GUIDANCE = 7.5
DIFFUSERS_SIZE = (1024, 1024)
OPENAI_QUALITY = "standard"
OPENAI_SIZE = "1024x1024"
STABILITY_ASPECT_RATIO = "1:1"
STABILITY_FORMAT = "png"
# Hosted prompt length limit: longer prompts keep 3997 characters plus "...".
PROMPT_CHAR_LIMIT = 4000

# Fallback section when the model answer is unusable.
FALLBACK_EMPTY = {
    "start_time": 0.0, "end_time": 0.0, "transcript_text": "", "image_prompt": "A generic scene",
    "sentiment": "neutral", "scene_description": "No transcript available", "visual_style": "realistic",
}
FALLBACK_PROMPT_PREFIX = "A scene depicting: "
FALLBACK_SCENE = "Full video content"
FALLBACK_SENTIMENT = "neutral"
FALLBACK_STYLE = "realistic"
FALLBACK_TEXT_CHARS = 500
FALLBACK_PROMPT_CHARS = 200

# Default language when neither forced nor detected.
DEFAULT_LANGUAGE = "en"
# Default video name when a prompts document has none.
DEFAULT_VIDEO_NAME = "video"

# Documented unit prices per image (USD; low end for the hosted diffusion API).
IMAGE_UNIT_PRICE = [("diffusers", "0.0000"), ("openai", "0.0400"), ("stability", "0.0040")]

# Canonical watch address and the pattern of an id in a shorts address.
WATCH_PREFIX = "https://www.youtube.com/watch?v="
SHORTS_PATTERN = r"(?:youtube\.com|youtu\.be)/shorts/([A-Za-z0-9_-]{5,})"
# Fields of a section, in the order of the documents.
SECTION_FIELDS = ["start_time", "end_time", "transcript_text", "image_prompt", "sentiment",
                  "scene_description", "visual_style"]
# ----------------------------------------------------------- END FIXED VALUES

# Our own request template (not the original instruction prose).
REQUEST_SYSTEM = "You turn timed transcripts into scenes for illustration. Answer with JSON only."
REQUEST_TEMPLATE_HEAD = (
    "Split the timed transcript below into scenes. For every scene return start_time, end_time, "
    "transcript_text, image_prompt, sentiment, scene_description and visual_style as a JSON object "
    "with a \"sections\" array.\n\nLanguage: "
)
REQUEST_TEMPLATE_MID = "\n\nTranscript:\n"
