"""Fixed values the results depend on: names, folders, patterns."""

from __future__ import annotations

# Names close to popular ones that are known to be legitimate.
TYPOSQUAT_ALLOWED = [
    "requests-oauthlib",
    "google-api-core",
    "googleapis-common-protos",
    "djangorestframework",
    "typing-extensions",
]

# Folders that never hold first-party code.
VENDOR_DIRS = [
    ".venv", "venv", "env", ".env", "site-packages", "node_modules", ".git",
    "__pycache__", "build", "dist", ".tox", ".eggs", ".mypy_cache",
    ".pytest_cache", "vendor", "__pypackages__",
]

# Folders the import scan skips in addition.
EDITOR_DIRS = [".idea", ".vscode"]

# Folders of a dependency that are not part of its library code.
DEPENDENCY_SKIP_DIRS = ["__pycache__", "tests", "test", ".dist-info", ".egg-info"]

# Import names that differ from the distribution that ships them.
IMPORT_TO_DIST = {
    "yaml": "pyyaml",
    "cv2": "opencv-python",
    "PIL": "pillow",
    "sklearn": "scikit-learn",
    "bs4": "beautifulsoup4",
    "jose": "python-jose",
    "jwt": "pyjwt",
    "dateutil": "python-dateutil",
    "dotenv": "python-dotenv",
    "google": "protobuf",
    "OpenSSL": "pyopenssl",
    "Crypto": "pycryptodome",
    "serial": "pyserial",
    "usb": "pyusb",
    "win32api": "pywin32",
    "lxml": "lxml",
    "markdown": "markdown",
    "attr": "attrs",
    "zoneinfo": "backports-zoneinfo",
    "pkg_resources": "setuptools",
    "_cffi_backend": "cffi",
    "nacl": "pynacl",
    "ruamel": "ruamel-yaml",
    "memcache": "python-memcached",
    "redis": "redis",
    "psycopg2": "psycopg2-binary",
    "MySQLdb": "mysqlclient",
    "grpc": "grpcio",
    "git": "gitpython",
    "slugify": "python-slugify",
    "magic": "python-magic",
    "docx": "python-docx",
    "pptx": "python-pptx",
    "fitz": "pymupdf",
    "Xlib": "python-xlib",
}

# Popular distribution names, the reference set for look-alike checks.
POPULAR_NAMES = """
requests urllib3 setuptools certifi charset-normalizer idna wheel pip six
python-dateutil pyyaml boto3 botocore s3transfer numpy typing-extensions
packaging cryptography jmespath pandas importlib-metadata attrs click pydantic
rsa pyasn1 markupsafe jinja2 flask werkzeug itsdangerous scipy google-api-core
protobuf googleapis-common-protos cachetools pyparsing zipp colorama pytz
requests-oauthlib oauthlib wrapt pyjwt async-timeout aiohttp frozenlist
multidict yarl sqlalchemy pillow matplotlib scikit-learn docutils pyarrow
grpcio tqdm psutil beautifulsoup4 soupsieve lxml websocket-client pyopenssl
pycparser cffi distlib filelock platformdirs virtualenv more-itertools tomli
pluggy pytest coverage greenlet fsspec joblib threadpoolctl opencv-python
pymysql psycopg2-binary redis celery kombu amqp vine billiard gunicorn uvicorn
fastapi starlette httpx httpcore sniffio anyio h11 django djangorestframework
asgiref sqlparse pymongo elasticsearch kafka-python confluent-kafka paramiko
bcrypt pynacl passlib python-jose python-multipart python-dotenv gitpython
smmap gitdb pygments rich typer shellingham markdown mako alembic marshmallow
webargs sentry-sdk structlog loguru tenacity backoff httptools watchfiles
websockets orjson ujson msgpack pyzmq tornado twisted gevent eventlet selenium
scrapy nltk spacy torch tensorflow keras transformers openai anthropic
langchain tiktoken
""".split()

# Manifest file names and how much each is trusted.
MANIFEST_RANK = {
    "pdm.lock": 40,
    "poetry.lock": 40,
    "uv.lock": 40,
    "Pipfile.lock": 35,
    "requirements.txt": 20,
}

# Calls in dependency source that are worth a look.
CODE_EXECUTION_CALLS = ["eval", "exec"]
BASE64_DECODERS = ["b64decode", "b32decode", "b16decode"]
NETWORK_MODULES = ["urllib", "requests", "socket"]
NETWORK_CALLS = ["urlopen", "get", "post", "connect"]
SUBPROCESS_CALLS = ["Popen", "run", "call", "check_output"]
