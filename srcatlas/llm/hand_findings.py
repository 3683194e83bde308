"""Findings written and labelled by hand, as they stand in notes, mails, settings, logs and code.

A secret stands in «», what only looks like one in ‹›.  Every other pair of lines trains the forest beside
those made by rule; the others are held out for tests.
"""

from __future__ import annotations

LINES = r"""
config/prod.env|DB_PASSWORD=«abc$%12XYZ!»
src/auth.py|MAX_TOKEN_AGE = ‹86400›
config/prod.env|MY_VERY_LONG_COMPANY_SERVICE_PRODUCTION_DB_PASSWORD=«abc$%19XQZ!»
docs/api.md|token: ‹string› (required)
notes.txt|password_for_the_production_db = «Tr0ub4dor&3»
docs/setup.md|Set password = ‹<your-password>› before the first start
settings.yaml|db_password: "«correct horse battery staple»"
settings.yaml|password_policy: "‹at least twelve characters›"
settings.yaml|db_password: '«blue kettle, seven ravens»'
form.html|password: "‹Enter your password›"
mail.txt|Hi Tom, the password is «hunter2xyz», please change it after login.
mail.txt|Hi Tom, the password is ‹required› for every account.
chat.log|pwd=«hunter2»
chat.log|pwd=‹/home/tom/projects›
chat.log|pwd=«sunsh1ne!»
shell.log|pwd: ‹/var/lib/app›
deploy.sh|git clone https://deploy:«S3cr3tPass»@git.example.net/app.git
deploy.sh|git clone https://github.com/user/‹internationalization-helpers›.git
backup.sh|mysql://root:«n0tS0Secret»@10.0.0.7/shop
README.md|mysql://user:‹password›@localhost/db
README.md|postgres://app:‹<password>›@localhost/app
values.yaml|postgres://app:«vq83Kd02ms»@db.internal:5432/app
app.ini|password=«abc,defGHI123xyz»
app.ini|password=‹None›
app.ini|secret = «9f;Kd!22x»
app.ini|secret = ‹null›
main.py|api_key = os.environ["‹STRIPE_KEY_FOR_PAYMENTS›"]
main.py|api_key = "«pk9dk2Lq0Zx81mmA»"
main.py|token = ‹get_token_from_request(request)›
main.py|token = "«d41d8cd98f00b204e9800998ecf8427e»"
main.py|token = ‹self.tokenizer.next_token()›
main.py|password = ‹getpass.getpass()›
main.py|auth_token = "«kJ8s-Pw2x_Lq9»"
main.py|secret_name = "‹payments-database-credentials›"
main.py|client_secret: "«Z8fk2nqPw01LsmX»"
ci.yml|password: ‹${{ secrets.DB_PASSWORD }}›
ci.yml|API_KEY: «a8f5f167f44f4964e6c998dee827110c»
ci.yml|key: ‹build-cache-linux-amd64-v3›
ci.yml|token: ‹${GITHUB_TOKEN}›
ci.yml|SECRET_KEY_BASE: «0a3f9c77e1b24d58a6cc90ff12ab34de»
lock.json|integrity sha512 ‹9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08›
lock.json|resolved commit ‹4f2a1c9d8e7b6a5f4e3d2c1b0a9f8e7d6c5b4a39›
git.log|commit ‹8c45435718dcc700c184a7e303cdc64c6a8f7f02›
git.log|revision ‹0d1a26e67d8f5eaf1f6ba5c57fc3c7d91ac0fd1c›
trace.log|request id ‹550e8400-e29b-41d4-a716-446655440000› took 12 ms
trace.log|trace ‹f81d4fae-7dec-11d0-a765-00a0c91e6bf6› ended
mail.txt|login with «xK9#mP2$vL5n» until Friday
mail.txt|my new passphrase is "«seven green lamps»"
mail.txt|the token was «8sKd92LmQp» yesterday
mail.txt|the token was ‹expired› yesterday
mail.txt|the secret is ‹patience›, said the old man
mail.txt|Her password was «Maria1987!»
guide.md|a password is ‹something› that only you know
guide.md|the api key is ‹optional› here
hosts.txt|wifi password: «Gartenzwerg77»
hosts.txt|wifi password: ‹ask at the desk›
hosts.txt|router pwd: «adm1n-2290»
menu.txt|key: ‹C major›, tempo: fast
headers.txt|Authorization: Bearer «eyK3dk29sLqPz01mmXw8Rt5Yb7Nc»
headers.txt|Authorization: Bearer ‹<access-token-goes-here>›
curl.sh|curl -H "X-Auth-Token: «77ac0f3be19d4c58»" https://api.internal/v1
curl.sh|curl -H "X-Auth-Token: ‹$TOKEN›" https://api.internal/v1
test_login.py|password = "‹test123test›"
test_login.py|token = "‹dummy-token-for-tests›"
docs/env.md|API_KEY=‹xxxxxxxxxxxxxxxx›
docs/env.md|SECRET=‹changeme›
prod.properties|keystore.password=«ks!9Wq22»
prod.properties|password.encoder=‹bcrypt›
prod.properties|jdbc.password=«pa55w0rd-Live»
prod.properties|token.validity=‹3600›
notes.txt|root pw on the box: use password «Kartoffel#42»
notes.txt|see class ‹AbstractAuthenticationTokenFilterFactory› for details
notes.txt|export AWS_SECRET_ACCESS_KEY=«wJalrXUtnFEMIK7MDENGbPxRfiCYzzKEYzz1»
notes.txt|https://cdn.site.org/assets/‹application-3f9a2bc17de4408b9f21.js›
"""


def _finding(line: str) -> tuple[str, int, int, str, int]:
    path, text = line.split("|", 1)
    label = int("«" in text)
    opening, closing = "«»" if label else "‹›"
    before, rest = text.split(opening, 1)
    value, after = rest.split(closing, 1)
    return before + value + after, len(before), len(value), path, label


def hand_findings(held_out: bool = False) -> list[tuple[str, int, int, str, int]]:
    """(text, start, length, path, label: 1 for a secret) of the lines for training, or of those held out."""
    lines = [x for x in LINES.splitlines() if x]
    return [_finding(x) for k, x in enumerate(lines) if k // 2 % 2 == int(held_out)]
